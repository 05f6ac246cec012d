"""Registered queries against brute force over their whole inputs."""

from millrace.plans import catalog
from millrace.plans import views as V
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_pad_batch_takes_every_document(spark):
    rows = sorted((r["doc_id"], list(r["ids"])) for r in V.documents(spark, SF).select("doc_id", V.tokens_hashed(F.col("text")).alias("ids")).collect())
    text = lambda x: ",".join(map(str, x))
    want = {}
    for k in range(0, len(rows), 4):
        longest = max(len(ids) for _, ids in rows[k : k + 4])
        for i, ids in rows[k : k + 4]:
            short = longest - len(ids)
            want[i] = (k // 4, text(ids + [0] * short), text(ids + [-100] * short), text([1] * len(ids) + [0] * short))
    got = catalog.QUERIES["pad_batch"](spark, SF).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["batch_id"], r["input_ids"], r["labels"], r["attention_mask"]) for r in got} == want


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_levenshtein_similarity_compares_whole_texts(spark):
    plain = lambda t: "".join(c if c < "\x80" else "?" for c in t)
    turns = {(r["conv_id"], r["turn"]): plain(r["text"]) for r in V.table(spark, SF, "conversations").collect()}
    pairs = {k: (t, turns[k[0], k[1] + 1]) for k, t in turns.items() if (k[0], k[1] + 1) in turns}
    got = {(r["conv_id"], r["turn"]): r["similarity"] for r in catalog.QUERIES["levenshtein_similarity"](spark, SF).collect()}
    assert set(got) == set(pairs) and any(max(map(len, p)) > 200 for p in pairs.values())
    for k, (a, b) in pairs.items():
        assert abs(got[k] - (1 - brute_distance(a, b) / max(len(a), len(b)) if a or b else 1)) < 1e-6
