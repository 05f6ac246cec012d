"""Every stage of the pipeline against brute force, on what its predecessor kept; learned rules step by step."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from millrace.llm import packing as P
from millrace.llm import quality_rules as Q
from millrace.llm import suffix_dedup as D
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_rules(rows, most_rules=Q.MAX_RULES):
    """Sequential covering by direct counts. ``rows``: dicts of features, ``bad`` and ``prune``; the cuts are the engine's, which are checked apart."""
    cuts = {f: sorted({x for r in rows for x in r["cuts"][f]}) for f in Q.FEATURES}
    meets = lambda r, c: r[c[0]] > c[2] if c[1] else r[c[0]] <= c[2]
    left, rules = list(rows), []
    while len(rules) < most_rules:
        pool, picked = [r for r in left if not r["prune"]], []
        for _ in range(Q.MAX_CONDITIONS):
            bad, good = sum(r["bad"] for r in pool), sum(not r["bad"] for r in pool)
            if bad < Q.MIN_COVER or not good:
                break
            best = (0.0, None)
            for f in Q.FEATURES:
                for cut in cuts[f]:
                    for above in (True, False):
                        p = sum(r["bad"] and meets(r, (f, above, cut)) for r in pool)
                        q = sum(not r["bad"] and meets(r, (f, above, cut)) for r in pool)
                        if p >= Q.MIN_COVER and p + q < bad + good:
                            gain = p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, above, cut))
            if best[1] is None:
                break
            picked.append(best[1])
            pool = [r for r in pool if meets(r, best[1])]
        if not picked:
            break
        held = [r for r in left if r["prune"]]
        tests = []
        for k in range(1, len(picked) + 1):
            own = [r for r in held if all(meets(r, c) for c in picked[:k])]
            p = sum(r["bad"] for r in own)
            tests.append(((2 * p - len(own)) / max(1, len(own)), -k, p, len(own)))
        _, k, p, n = max(tests)
        if p < max(1, Q.MIN_COVER // 2) or p < Q.MIN_PRECISION * n:
            break
        rules.append(tuple(picked[:-k]))
        left = [r for r in left if not all(meets(r, c) for c in rules[-1])]
    return rules


def test_learned_rules_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        bad = bool(rng.random() < 0.3)
        kind = rng.integers(0, 2)
        row = {f: float(rng.random()) for f in Q.FEATURES}
        if bad:
            row["symbols_per_char" if kind else "repeat_share"] = float(0.8 + rng.random())
            row["digit_share"] = float(rng.random() * (0.5 if kind else 1.0))
        rows.append({"doc_id": i, "bad": bad, **row})
    df = spark.createDataFrame(rows, "doc_id long, bad boolean, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    got = [tuple((c.feature, c.above, c.threshold) for c in r.conditions) for r in Q.learn_rules(df)]
    prune = {r["doc_id"]: r["p"] for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("p")).collect()}
    marks = df.groupBy("bad").agg(*[F.percentile_approx(f, Q.QUANTILES, 1000).alias(f) for f in Q.FEATURES]).collect()
    cuts = {}
    for f in Q.FEATURES:
        v = sorted({float(x) for r in marks for x in r[f]})
        cuts[f] = [(a + b) / 2 for a, b in zip(v, v[1:])]
    want = brute_rules([{**r, "prune": prune[r["doc_id"]], "cuts": cuts} for r in rows])
    assert got == want and len(want) >= 2


def brute_verdict(row):
    """The list as it is written out, applied to the statistics."""
    if row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"]:
        return "base"
    return None


def holds(rule, row):
    def one(condition):
        name, sign, cut = condition.split(" ")
        return row[name] > float(cut) if sign == ">" else row[name] <= float(cut)

    return all(map(one, rule.split(" and ")))


def test_verdicts_follow_the_list(spark):
    sf = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in Q.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()]
    rules = list(dict.fromkeys(r["rule"] for r in rows if r["rule"] not in (None, "base")))
    assert rules
    for r in rows:
        first = brute_verdict(r)
        met = [x for x in rules if holds(x, r)]
        assert r["base_failed"] == (first == "base") and r["kept"] == (first is None and not met)
        assert r["rule"] == (first or (r["rule"] if met else None)) and (not met or first or r["rule"] in met)


def brute_shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_near(rows):
    sets = [brute_shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    keep = {min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in set(label)}
    return [r for r in rows if r[0] in keep]


def brute_cut(rows, n):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept, at = [], 0
        for c in t.decode():
            size = len(c.encode())
            if not any(gone[at : at + size]):
                kept.append(c)
            at += size
        text = "".join(kept)
        if not any(gone) or re.search(r"[^\x20\x09-\x0D]", text):
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def brute_clean(rows, items):
    """Documents in which no item has half of its words under greedy tiles of five words or more."""
    out = []
    for r in rows:
        doc = re.findall(r"\w+", (r[1] or "").lower())
        dirty = False
        for item in items:
            k = min(5, len(item))
            grams = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)}
            if k == 0 or not any(tuple(doc[j : j + k]) in grams for j in range(len(doc) - k + 1)):
                continue
            a, b, total = [True] * len(item), [True] * len(doc), 0
            while True:
                best = (0, 0, 0)
                for i in range(len(item)):
                    for j in range(len(doc)):
                        n = 0
                        while i + n < len(item) and j + n < len(doc) and a[i + n] and b[j + n] and item[i + n] == doc[j + n]:
                            n += 1
                        best = max(best, (n, -i, -j))
                n, i, j = best[0], -best[1], -best[2]
                if n < k:
                    break
                total += n
                a[i : i + n], b[j : j + n] = [False] * n, [False] * n
            dirty |= total >= 0.5 * len(item)
        if not dirty:
            out.append(r)
    return out


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = lambda df: sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())
    rows = plain(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near-duplicates", "repeated strings", "benchmark passages", "packing"]

    def step(name):
        nonlocal docs
        out = stages[name](spark, docs, SF)
        assert out.columns == COLUMNS
        got = plain(out)
        docs = spark.createDataFrame(got, docs.schema)
        return got

    judged = {r["doc_id"]: r for r in (x.asDict() for x in Q.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect())}
    rules = [r["rule"] for r in judged.values() if r["rule"] not in (None, "base")]
    want = [r for r in rows if not brute_verdict(judged[r[0]]) and not any(holds(x, judged[r[0]]) for x in set(rules))]
    sizes = [len(rows), len(want)]
    assert step("quality rules") == want
    for name, brute in (("near-duplicates", brute_near), ("repeated strings", lambda x: brute_cut(x, corpus_pipeline.REPEAT_BYTES))):
        want = sorted(brute(want))
        assert step(name) == want
        sizes.append(len(want))
    items = [re.findall(r"\w+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_clean(want, items)
    assert step("benchmark passages") == want
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > len(want) > 0
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in want}
    by_doc, by_sequence = {}, Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_sequence[r["sequence_id"]] += r["length"]
    assert set(by_doc) == set(ids) and max(by_sequence.values()) <= P.CAPACITY
    for d, pieces in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and total == len(ids[d]) and crc == zlib.crc32(np.array(ids[d][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[d])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repeated_strings_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    want = Counter(con.execute(D.OP2_SQL).fetchall())
    got = D.op2_suffix_dedup(spark, f"/root/testdata/{sf}").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want and any(r["n_removed"] for r in got)


def test_stages_take_nothing_and_odd_rows(spark, tmp_path):
    """An empty table, and one of nulls, repeated rows, extra columns of clashing names and a map."""
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = " ".join(f"word{i}" for i in range(80))
    rows = [(1, words, "en", "s", len(words)), (1, words, "en", "s", len(words)), (None, words, None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.withColumns({"row": F.lit(1), "id": F.lit(2), "k1": F.lit("x"), "component_id": F.lit(0), "score": F.create_map(F.lit("a"), F.lit(1)), "group": F.lit(3), "__id": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, odd, str(tmp_path))
        if name != "packing":
            assert out.columns == odd.columns, name
        out.collect()
    kept = stages_of("near-duplicates")(spark, odd, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter({(1, words): 2, (None, words): 1, (2, None): 1})
    cut = stages_of("repeated strings")(spark, odd, str(tmp_path)).collect()
    assert Counter(r["text"] for r in cut) == Counter({"": 2})
    assert Counter(r["doc_id"] for r in stages_of("quality rules")(spark, odd, str(tmp_path)).collect()) == Counter({1: 2, None: 1})
    assert stages_of("benchmark passages")(spark, odd, str(tmp_path)).count() == len(rows)


def stages_of(name):
    return dict(corpus_pipeline.STAGES)[name]
