"""Token ids of texts that hold an added token literally."""

from tokenizers import Tokenizer

from millrace.llm import packing as P


def test_added_tokens_keep_their_id(spark):
    json_tokenizer = Tokenizer.from_file(P.vocabulary_path(kind="json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext|", "no token  here "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in P.pieces(docs, P.vocabulary_path(), with_ids=True).collect()}
    assert got == {i: json_tokenizer.encode(t, add_special_tokens=False).ids + [P.END_ID] for i, t in enumerate(texts)}
    assert 50256 not in P.encoder(P.vocabulary_path())("a <|endoftext|> b")
