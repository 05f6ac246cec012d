"""Texts of some megabytes through every operator, and scratch folders."""

import re

import numpy as np
import pytest
import xxhash
from millrace.llm import common, language, near_copies, simhash, suffix_dedup, toxicity, weak_labels
from millrace.llm import quality_rules as Q
from millrace.llm import token_files as K
from millrace.llm.packing import encoder, vocabulary_path
from pyspark.sql import functions as F

WORDS = ["the", "Cat", "sat", "on", "größe", "mat,", "again.", "\n"]


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(0)
    return " ".join(f"{WORDS[i]}{j}" if j % 3 else WORDS[i] for i, j in zip(rng.integers(0, len(WORDS), 500_000).tolist(), rng.integers(0, 1000, 500_000).tolist()))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return spark.createDataFrame([(1, long_text, "en"), (2, "ein kurzer Text", "de"), (3, None, "de"), (4, "x" * 3_000_000, "en")], "doc_id long, text string, lang string")


def test_fingerprints(spark, docs, long_text):
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in long_text.encode()))
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)], np.uint64)
    assert got[1] == sum(1 << k for k in range(64) if 2 * int(((h >> np.uint64(k)) & np.uint64(1)).sum()) > len(h))
    assert got[4] == xxhash.xxh64_intdigest(b"x" * 3_000_000, 42) and got[3] == 0
    assert {r["id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 4
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.train(docs)).collect()} == {1: "en", 2: "de", 3: "und", 4: "en"}
    assert weak_labels.score(docs, weak_labels.train(docs)[0]).count() == 4


def test_statistics(spark, docs, long_text):
    row = Q.text_stats(docs).where("doc_id = 1").first()
    words = re.findall(r"[^\x20\x09-\x0D]+", long_text)
    assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))


def test_token_files(spark, docs, long_text, tmp_path):
    path = common.scratch_path(spark, "test")
    K.write_token_files(docs, path)
    encode = encoder(vocabulary_path())
    got = sorted(r["n_tokens"] for r in K.count_tokens(spark, path).collect())
    assert got == sorted(len(encode(t)) for t in (long_text, "ein kurzer Text", "", "x" * 3_000_000))


def test_repeats(spark, docs, long_text):
    twice = docs.unionByName(spark.createDataFrame([(5, "new " + long_text[1000:2000] + " end", "en")], docs.schema))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(twice).select("row.doc_id", "n_removed").collect()}
    size = len(long_text[1000:2000].encode())
    assert size <= got[5] <= size + 2 and got[1] == got[5] and got[2] == got[3] == 0 and got[4] == 3_000_000


def test_scratch_is_shared_or_refused(spark, monkeypatch):
    one = common.materialise(spark.range(5), "test")
    assert one.count() == 5
    common.discard(one)
    with pytest.raises(Exception):
        one.collect()

    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://there:7077"

    with pytest.raises(ValueError):
        common.scratch_path(Far, "x")
    Far.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        common.scratch_path(Far, "x")
