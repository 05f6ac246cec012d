"""Classifiers by held-out accuracy, quality rules by exact statistics, decontamination by brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate as B
from millrace.llm import language, ngrams, toxicity, weak_labels
from millrace.llm import quality_rules as Q
from millrace.llm.common import held_out_fold

SF = "/root/testdata/sf0.01"
EDGE = [(1, None, None), (2, "", "en"), (None, "x", "en"), (2, "", "en"), (3, "word " * 20_000, "en"), (4, "12 34", "en"), (5, "the\tcat\n\nsat", "en")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))


def test_toxicity_held_out(spark):
    out = toxicity.op7_toxicity(spark, SF)
    known = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = out.join(known, "doc_id").where("held_out").collect()
    bad = [r["score"] for r in rows if r["toxic"] == 1]
    good = [r["score"] for r in rows if r["toxic"] == 0]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.85
    assert np.mean([g < 0.5 for g in good]) > 0.97
    assert out.count() == 1000 and out.where("score not between 0 and 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_toxicity_cases(spark, edge):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (5, None), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels)
    assert toxicity.score(edge, model).count() == len(EDGE)
    one = toxicity.train(edge, labels.where("toxic = 0"))
    assert {r["score"] < 0.5 for r in toxicity.score(edge, one).collect()} == {True}
    assert toxicity.score(edge.limit(0), toxicity.train(edge.limit(0), labels)).count() == 0


def test_language_held_out(spark):
    out = language.op9_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98


def test_language_cases(spark, edge):
    got = language.predict(edge, language.train(edge)).collect()
    by = Counter((r["doc_id"], r["lang_pred"]) for r in got)
    assert by == Counter([(1, "und"), (2, "und"), (2, "und"), (None, "en"), (3, "en"), (4, "und"), (5, "en")])
    assert {r["lang_pred"] for r in language.predict(edge, language.train(edge.where("lang is null"))).collect()} == {"und"}
    assert language.predict(edge.limit(0), None).count() == 0


def brute_id(gram, bits):
    """The hash of one n-gram, step by step."""
    h, mask = 0, (1 << 64) - 1
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) & mask
    x = ((h + len(gram)) * 0x9E3779B97F4A7C15) & mask
    x ^= x >> 29
    return (x * 0x9E3779B97F4A7C15 & mask) >> (64 - bits)


def brute_grams(text, sizes):
    text = text.lower()
    return [text[i : i + n] for n in sizes for i in range(len(text) - n + 1)]


def test_ngrams_are_characters_and_count_once(monkeypatch):
    texts = ["", "a", "Straße Ünï", "日本語のテキスト", "ab" * 60, "e\u0301 😀 Xy"]
    for chunk in (1 << 17, 7):
        monkeypatch.setattr(ngrams, "CHUNK", chunk)
        for t in texts:
            got = Counter(np.concatenate(list(ngrams.ngram_ids(ngrams.code_points(t), (1, 2, 4), 12))).tolist())
            assert got == Counter(brute_id(g, 12) for g in brute_grams(t, (1, 2, 4)))
            assert dict(zip(*(x.tolist() for x in ngrams.ngram_counts(ngrams.code_points(t), (1, 2, 4), 12)))) == got


def test_language_equals_brute_force(spark, monkeypatch):
    rows = [(1, "der Hund und die Katze", "de"), (2, "the dog and the cat", "en"), (3, "le chien et le chat", "fr"), (4, "der Tag", "de"), (5, "日本語のテキスト", "ja"), (6, None, "en"), (7, "", "fr")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names = sorted({r[2] for r in rows})
    prior = {x: math.log(sum(r[2] == x for r in rows) / len(rows)) for x in names}
    count = {x: Counter(brute_id(g, language.BITS) for r in rows if r[2] == x for g in brute_grams(r[1] or "", language.SIZES)) for x in names}
    room = {x: sum(count[x].values()) + language.SMOOTHING * (1 << language.BITS) for x in names}
    asked = ["die Katze und der Hund", "and", "語", "le the der", "Ärger", "the cat " * 50]
    for most in (1 << 19, 10):
        monkeypatch.setattr(language, "SCORED_AT_ONCE", most)
        got = model.totals(asked)
        for t, z in zip(asked, got):
            want = [prior[x] + sum(math.log((count[x][brute_id(g, language.BITS)] + language.SMOOTHING) / room[x]) for g in brute_grams(t, language.SIZES)) for x in names]
            assert np.allclose(z, want)
    out = language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    for r in out:
        z = got[r["doc_id"]]
        assert r["lang_pred"] == names[int(np.argmax(z))] and abs(r["score"] - 1 / np.exp(z - z.max()).sum()) < 1e-9


def test_many_languages_take_fewer_bits(spark):
    assert language.bits_for(4) == 15 and all((1 << language.bits_for(n)) * n * 8 <= language.MATRIX_BYTES for n in (300, 5000, 1 << 16))
    rows = [(i, f"word{i} again", f"l{i}") for i in range(600)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 600 and model.bits == language.bits_for(600)


def test_toxicity_equals_brute_force(spark):
    """Presence counts, ratios and scores of a small model, step by step; and the fit is at its optimum."""
    rng = random.Random(5)
    bad, calm = ["Übel", "hässlich", "dumm"], ["schön", "gut", "Tag", "wir", "日本"]
    rows = [(i, " ".join([rng.choice(calm) for _ in range(8)] + [rng.choice(bad)] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.drop("text"))
    has = [{brute_id(g, toxicity.BITS) for g in brute_grams(f" {t} ", toxicity.SIZES)} for _, t, _ in rows]
    n = [Counter(h for s, r in zip(has, rows) if r[2] == y for h in s) for y in (0, 1)]
    # r = log((p / |p|) / (q / |q|)) of the count vectors p = 1 + presences in class 1, q = 1 + presences in class 0.
    every = n[0] | n[1]
    total = [sum(n[y][h] + 1 for h in every) for y in (0, 1)]

    def ratio(h):
        return math.log((n[1][h] + 1) / total[1] / ((n[0][h] + 1) / total[0]))

    support = {h: abs(ratio(h)) / math.sqrt(1 / (n[1][h] + 1) + 1 / (n[0][h] + 1)) for h in n[0] | n[1]}
    used = {h for h, s in support.items() if s > 2}
    assert set(np.flatnonzero(model.used).tolist()) <= used and len(used) <= toxicity.MAX_FEATURES
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    for (i, _, _), s in zip(rows, has):
        assert abs(scores[i] - 1 / (1 + math.exp(-(model.bias + sum(model.weight[h] for h in s & used))))) < 1e-9
    error = np.array([scores[i] - y for i, _, y in rows]) / len(rows)
    assert abs(error.sum()) < 0.01
    for h in list(used)[:50]:
        slope = sum(e for e, s in zip(error, has) if h in s) * ratio(h) + toxicity.L2 * model.weight[h] / ratio(h)
        assert abs(slope) < 0.01


def test_held_out_is_defined_for_null_ids(spark):
    df = spark.createDataFrame([(None,), (5,)], "doc_id long")
    assert [r[0] for r in df.select(held_out_fold("doc_id", 5) == 0).collect()] == [True, zlib.crc32(b"5") % 5 == 0]


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(zip(w, w[1:], w[2:]))
    spots = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if count[x] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(spots)


def test_quality_statistics_are_exact(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " a\tb \n\n a\tb \n"), (-4, "a b c a b c a"), (-5, "x " * 30_000), (-6, "é|é <é>")], "doc_id long, text string")
    rows = Q.text_stats(docs.unionByName(extra), ("doc_id", "text")).collect()
    assert len(rows) == 1006
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_stats(r["text"]), r["doc_id"]


def test_quality_rules_learn_and_keep(spark):
    out = Q.op10_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in out if r["quality"] == 1]
    bad = [r["kept"] for r in out if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4


def test_quality_cases(spark, edge):
    labels = spark.createDataFrame([(3, 1), (3, 0), (9, None), (None, 1)], "doc_id long, quality int")
    got = Q.judge(edge, labels).collect()
    assert len(got) == len(EDGE) and not any(r["kept"] for r in got) and all(r["base_failed"] for r in got)
    assert Q.keep_good(edge, labels).count() == 0 and Q.keep_good(edge, labels).columns == edge.columns
    assert Q.judge(edge.limit(0), labels.limit(0)).count() == 0


def test_quality_plan_is_native(spark, edge):
    plan = Q.features(Q.text_stats(edge))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def made_votes(rng, n):
    """Good documents and two faults; families of three labellers of very different worth, one of them with many false alarms."""
    kind = rng.choice(3, n, p=[0.8, 0.12, 0.08])
    family, hit, false = np.array([0, 0, 0, 1, 1, 1]), [0.95, 0.9, 0.5, 0.9, 0.85, 0.6], [0.01, 0.02, 0.15, 0.005, 0.02, 0.1]
    votes = np.full((n, 6), weak_labels.GOOD)
    for k in range(6):
        bad = np.where(kind == 1 + family[k], rng.random(n) < hit[k], rng.random(n) < false[k])
        votes[bad, k] = weak_labels.BAD
        votes[rng.random(n) < 0.1, k] = weak_labels.NONE
    return kind == 0, votes, family


def test_label_model_beats_majority_and_any_bad_vote():
    truth, votes, family = made_votes(np.random.default_rng(0), 6000)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.fit_label_model(patterns, counts, family)
    right = lambda good: (good == truth).mean()
    told = model.posterior(votes) > 0.5
    none_bad = (votes != weak_labels.BAD).all(axis=1)
    majority = (votes == weak_labels.GOOD).sum(axis=1) > (votes == weak_labels.BAD).sum(axis=1)
    assert right(told) > 0.95 and right(told) > right(majority) + 0.03 and right(told) > right(none_bad) + 0.1
    # Where a document has bad votes from a weak labeller alone, the estimated accuracies overrule it.
    conflict = ~none_bad & truth
    assert told[conflict].mean() > 0.9
    worth = model.accuracies()
    assert worth[0] > worth[1] > worth[2] and worth[3] > worth[5] and np.abs(model.unseen[:, weak_labels.BAD] / 0.9 - [0.01, 0.02, 0.15, 0.005, 0.02, 0.1]).max() < 0.03


def test_label_model_equals_brute_force():
    """EM over patterns equals EM over single documents, step by step."""
    _, votes, family = made_votes(np.random.default_rng(1), 60)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    for rounds in (1, 2, 7):
        model = weak_labels.fit_label_model(patterns, counts, family, rounds)
        post = []
        for v in votes.tolist():
            start = [0.5, sum(v[k] == 0 for k in range(3)), sum(v[k] == 0 for k in range(3, 6))]
            post.append([x / sum(start) for x in start])
        for _ in range(rounds):
            prior = [(sum(p[c] for p in post) + 1) / (len(votes) + 3) for c in range(3)]
            tables = []
            for k in range(6):
                seen, unseen = [1.0] * 3, [1.0] * 3
                unseen[0] += weak_labels.BELIEF * len(votes) * weak_labels.FALSE_BAD
                unseen[1] += weak_labels.BELIEF * len(votes) * (1 - weak_labels.FALSE_BAD)
                for v, p in zip(votes.tolist(), post):
                    seen[v[k]] += p[1 + family[k]]
                    unseen[v[k]] += 1 - p[1 + family[k]]
                tables.append([[x / sum(t) for x in t] for t in (seen, unseen)])
            post = []
            for v in votes.tolist():
                z = [prior[c] * math.prod(tables[k][0 if c == 1 + family[k] else 1][v[k]] for k in range(6)) for c in range(3)]
                post.append([x / sum(z) for x in z])
        assert np.allclose(model.classes(votes), post)


def test_weak_labels(spark, edge):
    out = weak_labels.op1_weak_labels(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert out.count() == 1000 and np.mean(good) > 0.95 and np.mean(bad) < 0.6
    scorer, _, _ = weak_labels.train(edge)
    assert weak_labels.score(edge, scorer).count() == len(EDGE)
    empty, _, _ = weak_labels.train(edge.limit(0))
    assert weak_labels.score(edge.limit(0), empty).count() == 0


def brute_tiles(item, doc, k):
    """Greedy string tiling, by looking at all pairs of places for the longest match again and again."""
    a, b, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and a[i + n] and b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return total
        total += n
        a[i : i + n] = [False] * n
        b[j : j + n] = [False] * n


def test_tiling_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(2)
    cases = [(rng.integers(0, 3, rng.integers(5, 25)), rng.integers(-1, 3, rng.integers(0, 40))) for _ in range(150)]
    cases += [(np.zeros(30, int), np.zeros(50, int)), (np.arange(12) % 2, np.arange(40) % 2)]
    for most in (1 << 20, 30):
        monkeypatch.setattr(B, "HITS_AT_ONCE", most)
        for item, doc in cases:
            index = B.Index.of([(7, [str(x) for x in item])], 3)
            ids = np.array([index.words.get(str(x), -1) for x in doc], np.int64)
            tiles = [t for _, _, matches in index.matches(ids) for t in B.tile(len(item), len(ids), matches(), 3)]
            taken = [p + i for p, _, n in tiles for i in range(n)]
            assert len(taken) == len(set(taken)) and all((index.items[0][p : p + n] == ids[a : a + n]).all() for p, a, n in tiles)
            assert sum(n for _, _, n in tiles) == brute_tiles(item.tolist(), doc.tolist(), 3)


def test_a_repeated_word_does_not_list_all_pairs():
    """A text of one word against an item of the same word: matches, not pairs, are held."""
    import tracemalloc

    index = B.Index.of([(1, ["so"] * 500)], 5)
    tracemalloc.start()
    [(item, tiles)] = B.found_in("so " * 20_000, index, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert item == 0 and tiles == [(0, 0, 500)] and peak < 300e6


def test_decontamination_query_equals_brute_force(spark):
    docs = {r["doc_id"]: re.findall(r"\w+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: re.findall(r"\w+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    seeds, want = {k: grams(w) for k, w in items.items()}, Counter()
    for d, w in docs.items():
        own = grams(w)
        for k, item in items.items():
            # Fewer words under shared seeds than half the item cannot make tiles of half of it.
            if 5 * len([1 for i in range(len(item) - 4) if tuple(item[i : i + 5]) in own]) >= 0.5 * len(item) and own & seeds[k]:
                at = [j for j in range(len(w) - 4) if tuple(w[j : j + 5]) in seeds[k]]
                near = sorted({j + x for j in at for x in range(5)})
                cut = [w[j] if j in set(near) else None for j in range(len(w))]
                n = brute_tiles(item, cut[near[0] : near[-1] + 1], 5)
                if n >= 0.5 * len(item):
                    want[d, k, len(item), n] += 1
    got = Counter((r["doc_id"], r["item_id"], r["item_words"], r["matched_words"]) for r in B.op8_decontaminate(spark, SF).collect())
    assert got == want and len(want) > 10


def test_decontamination(spark):
    item = [f"w{i}" for i in range(40)]
    reordered = " ".join(item[20:] + ["x"] + item[:20])
    docs = spark.createDataFrame([(1, "a b " + " ".join(item).upper() + "! z"), (2, reordered), (3, " ".join(item[:12])), (4, None), (5, ""), (None, reordered), (2, reordered)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "too few"), (12, "other words of another item here")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = Counter((r[0], r[1]) for r in B.contaminated(docs, bench).collect())
    assert got == Counter([(1, 9), (2, 9), (2, 9), (None, 9)])
    blocks = Counter((r[0], r[1]) for r in B.contaminated(docs, bench, block_words=5).collect())
    assert blocks == got
    same = B.contaminated(docs, bench.drop("doc_id").withColumnRenamed("item_id", "doc_id"), item_col="doc_id")
    assert Counter((r["doc_id"], r["benchmark_doc_id"]) for r in same.collect()) == got
    for words in (500_000, 5):
        kept = B.drop_contaminated(docs, bench, block_words=words)
        assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5] and kept.columns == docs.columns
    assert B.contaminated(docs, bench.limit(0)).count() == 0 and B.drop_contaminated(docs.limit(0), bench).count() == 0
    long = spark.createDataFrame([(1, "pad word " * 200_000 + " ".join(item))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in B.contaminated(long, bench).collect()] == [(1, 9)]


def test_ties_are_settled_by_name_and_by_hash(spark):
    """Of languages equally likely the first by name; of features equally well supported those of the least hash."""
    twins = spark.createDataFrame([(1, "same words", "zz"), (2, "same words", "aa"), (3, "same words", "mm")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.predict(twins, language.train(twins)).collect()} == {"aa"}
    # Texts of equal length, so that the n-grams of either class have equal shares.
    rows = [(i, "evil idea" if i % 2 else "good idea", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grams = [{brute_id(g, toxicity.BITS) for g in brute_grams(f" {t} ", toxicity.SIZES)} for t in ("good idea", "evil idea")]
    own = sorted(grams[0] ^ grams[1])
    model = toxicity.train(df.drop("toxic"), df.drop("text"), max_features=5)
    assert np.flatnonzero(model.used).tolist() == own[:5]
    assert {(r["doc_id"] % 2, r["score"] >= 0.5) for r in toxicity.score(df, model).collect()} == {(0, False), (1, True)}
