"""Sources, sinks, settings, streams and tokenizers by round trip."""

import gzip
import json
import re

import pytest
from millrace import config as C
from millrace.functions import text as T
from millrace.functions.tokenizer import DefaultTokenizer, VocabularyTokenizer
from millrace.operators import evaluation as E
from millrace.operators import execution, fim, repos, samples, splitter
from millrace.plans import catalog, views
from millrace.sources import readers, writers
from millrace.streaming import tokens
from pyspark.sql import functions as F


def records(spark):
    file = lambda p, n: (p, n, "Python", False, False, 80, 0.5, "b" + p, None)
    rows = [("o/a", "Python", 3, None, [file("x.py", 10), file("y.py", 20)]), ("o/b", None, None, 1, []), ("", "C", 1, 1, [file("z.c", 5)]), (None, "C", 1, 1, [file("z.c", 5)]), ("p/c", "C", 0, 0, [file("w.py", 7)])]
    return spark.createDataFrame(rows, readers.REPOS)


def test_repo_records(spark):
    got = readers.repo_files(records(spark)).collect()
    assert sorted((r["repo_name"], r["path"], r["length_bytes"], r["stars"], r["forks"]) for r in got) == [("o/a", "x.py", 10, 3, None), ("o/a", "y.py", 20, 3, None), ("p/c", "w.py", 7, 0, 0)]


def test_scan_order_and_limit(spark):
    rows = spark.createDataFrame([(f"r{i}", 100 - i) for i in range(50)], "repo_name string, at long")
    assert [r["repo_name"] for r in readers.scan_repos(rows, 3, ordinal_col="at").collect()] == ["r49", "r48", "r47"]
    one, again, other = ([r["repo_name"] for r in readers.scan_repos(rows.repartition(n), 20, seed=s).collect()] for n, s in ((1, 1), (7, 1), (3, 2)))
    assert set(one) == set(again) and set(one) != set(other) and len(one) == 20
    assert readers.scan_repos(rows, 1000).count() == 50


def test_benchmarks_are_read(spark, tmp_path):
    lines = {name: {f.name: f"{f.name} é" for f in spark.createDataFrame([], schema).schema} for name, (_, schema) in readers.BENCHMARKS.items()}
    for name, (file, _) in readers.BENCHMARKS.items():
        text = (json.dumps(lines[name]) + "\n") * 2
        (tmp_path / file).write_bytes(gzip.compress(text.encode()) if file.endswith(".gz") else text.encode())
    for name in readers.BENCHMARKS:
        assert [r.asDict() for r in readers.read_benchmark(spark, str(tmp_path), name).collect()] == [lines[name]] * 2


def test_metric_page(spark, tmp_path):
    (tmp_path / "m").write_text('# help\nhits{e="0"} 3\nhits{e="0"} 5\nqueries{e="0"} 20\n')
    page = readers.read_metric_page(spark, str(tmp_path / "m"))
    got = E.scrape_counters(page, ["hits", "queries"]).first()
    assert (got["hits"], got["queries"]) == (5.0, 20.0)


def test_source_trees_keep_replacement_characters(spark, tmp_path):
    (tmp_path / "t/r").mkdir(parents=True)
    (tmp_path / "t/r/a.py").write_bytes("x \ufffd \ufdd0 \ufdd0\ufdd1 \ufdd0\ufdd2".encode() + b"\xff\xfe y\xc3")
    assert [r["content"] for r in readers.read_source_tree(spark, str(tmp_path / "t")).collect()] == ["x \ufffd \ufdd0 \ufdd0\ufdd1 \ufdd0\ufdd2 y"]


def test_jsonl_append(spark, tmp_path):
    path = str(tmp_path / "o")
    for i in range(2):
        writers.write_jsonl(spark.createDataFrame([(f"é{i}",)], "x string"), path, append=True)
    assert sorted(r[0] for r in spark.read.json(path).collect()) == ["é0", "é1"]
    assert any("é" in f.read_text() for f in (tmp_path / "o").glob("part-*"))
    writers.write_jsonl(spark.createDataFrame([("z",)], "x string"), path)
    assert [r[0] for r in spark.read.json(path).collect()] == ["z"]


def test_metrics_are_one_file(spark, tmp_path):
    writers.write_metrics(spark.range(100).repartition(5).agg(F.sum("id").alias("s")), str(tmp_path / "m"))
    [file] = (tmp_path / "m").glob("part-*")
    assert json.loads(file.read_text()) == {"s": 4950}


def test_repositories_are_written_and_dropped(spark, tmp_path):
    files = spark.createDataFrame([("o/a", "x", "1"), ("o/a", "y", "2"), ("o/b", "z", "3"), ("p/c", "w", "4")], "repo_name string, path string, content string")
    picks = spark.createDataFrame([("o/a", 80.0, "why"), ("o/b", 70.0, "why")], "repo_name string, score double, reason string")
    path = str(tmp_path / "repos")
    writers.write_repos(files, picks, path)
    read = lambda: sorted((r["repo_name"], r["path"]) for r in writers.read_repos(spark, path).collect())
    names = lambda: sorted(r["repo_name"] for r in writers.read_picks(spark, path).collect())
    assert read() == [("o/a", "x"), ("o/a", "y"), ("o/b", "z")]
    writers.write_repos(files.where("path <> 'y'"), picks.where("repo_name = 'o/a'"), path)
    assert read() == [("o/a", "x"), ("o/b", "z")] and names() == ["o/a", "o/b"]
    writers.write_repos(files, picks, path)
    writers.drop_repos(spark, ["o/b", "not there"], path)
    assert read() == [("o/a", "x"), ("o/a", "y")] and names() == ["o/a"]
    writers.vacuum_repos(spark, path)
    assert read() == [("o/a", "x"), ("o/a", "y")] and names() == ["o/a"]
    writers.drop_repos(spark, ["o/a"], path)
    assert read() == [] and names() == []


def test_a_failed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("o/a", "x", "1"), ("p/c", "w", "4")], "repo_name string, path string, content string")
    picks = spark.createDataFrame([("o/a", 80.0), ("p/c", 60.0)], "repo_name string, score double")
    path = str(tmp_path / "repos")
    first = writers.write_repos(files, picks.where("repo_name = 'o/a'"), path)
    bad = files.withColumn("content", F.when(F.col("path") == "w", F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        writers.write_repos(bad, picks, path)
    with monkeypatch.context() as m:
        m.setattr(writers, "_commit", lambda *a: (_ for _ in ()).throw(OSError("no rename")))
        with pytest.raises(OSError):
            writers.write_repos(files, picks, path)
        with pytest.raises(OSError):
            writers.drop_repos(spark, ["o/a"], path)
    assert writers.repos_version(spark, path) == first
    assert [tuple(r) for r in writers.read_repos(spark, path).select("repo_name", "path", "content").collect()] == [("o/a", "x", "1")]
    writers.write_repos(files, picks, path)
    writers.vacuum_repos(spark, path)
    assert writers.read_repos(spark, path).count() == 2


def test_results_by_mode(spark, tmp_path):
    path = str(tmp_path / "r")
    writers.write_results(spark.createDataFrame([("fim", 1.0), ("efim", 2.0)], "mode string, em double"), path)
    writers.write_results(spark.createDataFrame([("fim", 3.0)], "mode string, em double"), path)
    assert sorted((r["mode"], r["em"]) for r in spark.read.json(path).collect()) == [("efim", 2.0), ("fim", 3.0)]


def test_streamed_scan(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    query = tokens.scan_stream(spark, str(tmp_path / "in"), "id long", lambda df, n: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert sorted(seen) == list(range(30))


def test_settings_from_yaml(tmp_path):
    (tmp_path / "c.yml").write_text("fim:\n  fim_rate: 0.8\neval:\n  programs_at_once: 3\n")
    cfg = C.Config.from_yaml(str(tmp_path / "c.yml"))
    assert cfg.fim.fim_rate == 0.8 and cfg.eval.programs_at_once == 3 and cfg.repo == C.RepoConfig()
    (tmp_path / "e.yml").write_text("")
    assert C.Config.from_yaml(str(tmp_path / "e.yml")) == C.Config()


def test_tasks_at_once(spark):
    assert execution.at_most(spark.range(1000), 3).rdd.getNumPartitions() == 3


def test_tokenizers_round_trip(spark):
    import public_tokenizers

    texts = ["", " ", "one  two\n3.5 é 日本 ", "\tx\n\n", "a" * 50, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for one in (DefaultTokenizer(), VocabularyTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))):
        coded = df.select("id", "text", one.encode(F.col("text")).alias("ids"), one.count(F.col("text")).alias("n"))
        for r in coded.select("*", one.decode(F.col("ids")).alias("back")).collect():
            assert r["back"] == r["text"] and (r["text"] is None or r["n"] == len(r["ids"]))
        # A byte-level token may be part of a character, so a cut text need not decode to itself there.
        plain = df.where("text is not null" if isinstance(one, DefaultTokenizer) else "id in (0, 1, 3, 4)")
        cut = fim.split_token_text(plain, F.col("text"), F.col("id"), one).collect()
        assert all(r["prefix"] is None or r["prefix"] + r["middle"] + r["suffix"] == r["text"] for r in cut)


def test_prompts_as_sql_functions(spark):
    for s in C.SENTINELS.values():
        fim.register_prompts(spark, s)
        rows = [("import os\ndef f(x):\r\n    y = ", "1", "x\n    return y\n\nclass C:\n    pass\n"), ("", "", ""), ("it's", "a\\n", "no mark"), ("def a():\n  x", "", "\n@d\ndef b()")]
        df = spark.createDataFrame(rows, "prefix string, middle string, suffix string")
        parts = F.col("prefix"), F.col("middle"), F.col("suffix")
        want = df.select(fim.prompt_fim(*parts, s).alias("a"), fim.prompt_efim(*parts, s).alias("b"), fim.prompt_sfim(*parts, s).alias("c")).collect()
        df.createOrReplaceTempView("prompt_parts")
        got = spark.sql("select prompt_fim(prefix, middle, suffix) as a, prompt_efim(prefix, middle, suffix) as b, prompt_sfim(prefix, middle, suffix) as c from prompt_parts").collect()
        assert sorted(got) == sorted(want)


def test_marks_by_model_and_texts_that_hold_one(spark):
    df = spark.createDataFrame([("Qwen2.5",), ("deepseek-coder",)], ["m"])
    assert [r[0] for r in df.select(fim.sentinel_column(F.col("m"), "mid")).collect()] == [C.SENTINELS["qwen"].mid, C.SENTINELS["deepseek"].mid]
    with pytest.raises(Exception):
        spark.createDataFrame([("other",)], ["m"]).select(fim.sentinel_column(F.col("m"), "mid")).collect()
    held = spark.createDataFrame([("a <|fim_middle|> b",), ("plain",)], ["t"]).select(fim.has_sentinel(F.col("t"))).collect()
    assert [r[0] for r in held] == [True, False]


def test_junk_names(spark):
    names = ["o/my-Demo", "o/demonstration", "Tutorial", "x/learn_spark", "x/archiver", "demo/real", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(repos.is_junk_name(F.col("n"))).collect()]
    assert got == [True, False, True, True, False, False, None]
    one = spark.createDataFrame([(True, 50, 0.9, 0, 90.0), (False, 1, 0.9, 0, 90.0)], "name_is_junk boolean, core_py_files int, core_py_ratio double, bucket int, score double")
    assert [r[0] for r in one.select(repos.reject_reason(C.RepoConfig())).collect()] == ["junk name", "few files"]


def test_joins_of_samples_and_problems(spark):
    problems = spark.createDataFrame([(1, 0, "old"), (1, 1, "new"), (2, 2, "b")], "task_id long, at long, prompt string")
    last = E.problem_dictionary(problems, "at").select("task_id", "prompt")
    assert {r["task_id"]: r["prompt"] for r in last.collect()} == {1: "new", 2: "b"}
    done = spark.createDataFrame([(1, "x"), (1, "y")], "task_id long, completion string")
    assert E.join_problems(done, last).where("prompt = 'new'").count() == 2
    assert [r["task_id"] for r in E.unattempted(last, done).collect()] == [2]
    with pytest.raises(Exception):
        E.join_problems(spark.createDataFrame([(9, "x")], "task_id long, completion string"), last).collect()


def test_value_statistics(spark):
    """Every rank is exact, whatever the values: ties, both signs, extremes, few and many."""
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=3000), "b": rng.integers(-3, 4, 999).astype(float), "c": np.exp(9 * rng.normal(size=1200)), "d": np.array([5.0]), None: np.array([1e-310, -1e150, 0.0, -0.0, 3.3, 1e150] * 30)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g string, value double").repartition(3)
    shares = [0.0, 0.3, 0.5, 0.99, 1.0]
    got = {r["g"]: list(r)[1:] for r in E.value_statistics(df, ["g"], shares).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        want = [len(vs), vs.mean(), vs.std(), *np.quantile(vs, shares)]
        assert np.allclose(got[k], want, rtol=1e-9, atol=1e-9 * np.abs(vs).max())
    assert np.allclose([E.value_statistics(df.select("value"), [], [0.3]).first()["p0"]], np.quantile(np.concatenate(list(groups.values())), 0.3))
    assert E.value_statistics(df.limit(0), ["g"], [0.5]).count() == 0


def test_histograms_refine_until_a_rank_is_an_extreme(spark, monkeypatch):
    """With cells so few that many rounds are needed, ranks are still exact; values of no rank are never put in order."""
    import numpy as np

    monkeypatch.setattr(E, "CELLS", 3)
    x = np.concatenate([np.linspace(1.0, 1.0001, 5000), [np.inf, -np.inf, 1e-320, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "value double")
    got = E.value_statistics(df, [], [0.0, 0.1, 0.5, 0.77, 1.0]).first()
    assert (got["p0"], got["p4"]) == (-np.inf, np.inf) and np.allclose(list(got)[4:7], np.quantile(np.where(np.isinf(x), np.sign(x) * 1e9, x), [0.1, 0.5, 0.77]), rtol=1e-12)
    assert E.value_statistics(df.limit(0), [], [0.5]).count() == 0
    assert np.isnan(E.value_statistics(df.limit(3).select(F.lit(float("nan")).alias("value")), [], [0.5]).first()["p0"])


def test_numbers_within_groups(spark):
    df = spark.createDataFrame([(i % 7 % 3, i * 5 % 1009) for i in range(1000)], "g long, k long").repartition(5)
    for by in ([], ["g"]):
        rows = T.numbered(df, by, "k", "n", 8).collect()
        seen = {}
        for r in sorted(rows, key=lambda r: r["k"]):
            key = tuple(r[c] for c in by)
            assert r["n"] == seen.get(key, 0)
            seen[key] = seen.get(key, 0) + 1
        assert len(rows) == 1000


def test_scan_stop(spark):
    rows = [(f"r{i:02}", {1: 0, 4: 1, 5: 0, 8: 1, 9: 1}.get(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "repo_name string, bucket int")
    assert repos.scan_stop(df, 2, 2, "repo_name").first()[0] == 9
    assert repos.scan_stop(df, 3, 2, "repo_name").first()[0] is None


def test_neighbours_by_literal_prefix(spark):
    """The first files below a folder's name equal those of all pairs."""
    paths = [f"{a}{b}/f{i}.py" for a in ("x", "y") for b in ("", "z", "/sub") for i in range(4)] + ["top.py", "x.py"]
    df = spark.createDataFrame([(r, p, f"text {p}") for r in ("r", "q") for p in paths], "repo_name string, path string, content string")
    got = {}
    for r in samples.cross_file_context(df, literal_prefix=True).collect():
        got.setdefault((r["repo_name"], r["path"]), []).append((r["rank"], r["context_path"]))
    for r in ("r", "q"):
        for p in paths:
            folder = p.rpartition("/")[0]
            want = sorted(x for x in paths if x != p and x.startswith(folder))[:5]
            assert [x for _, x in sorted(got.get((r, p), []))] == want


@pytest.mark.parametrize("literal", [False, True])
def test_neighbours_are_ordered_without_their_texts(spark, literal):
    """Texts of a repository met in one window before; the result equals that of all pairs, heads beyond the budget and null paths included."""
    words = lambda p: 600 if p.endswith("3.py") else 90 if p.endswith("1.py") else 5
    paths = [f"{a}{b}/f{i}.py" for a in ("x", "y") for b in ("", "z", "/sub") for i in range(4)] + ["x", "top.py", "x.py"]
    rows = [("r", p, "\n".join(["word"] * words(p))) for p in paths] + [("r", None, "a"), (None, "x/f1.py", "b")]
    df = spark.createDataFrame(rows, "repo_name string, path string, content string")
    cfg = C.SampleConfig(cross_lines=1000)
    out = samples.cross_file_context(df, cfg, literal)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    tokens = lambda x: len(re.findall(T.TOKEN, x))
    want = set()
    for p in paths:
        folder = p.rpartition("/")[0]
        start = folder if literal or not folder else folder + "/"
        running = 0
        for rank, x in enumerate(sorted(x for x in paths if x != p and x.startswith(start))[:5], 1):
            running += tokens(x) + 2 + words(x)
            if running <= 512:
                want.add(("r", p, rank, x, "word\n" * words(x), words(x), running))
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_contexts_are_attached_without_shuffling_contents(spark, monkeypatch, most):
    """Broadcast or hashed, equal to contexts made row by row and gathered again; contents were shuffled and sorted for that before."""
    monkeypatch.setattr(samples, "BROADCAST_BYTES", most)
    paths = [f"{a}/f{i}.py" for a in ("x", "x/y", "z") for i in range(7)] + ["top.py", "lone/only.py"]
    rows = [(r, p, f"text {p} " * (1 + i % 90)) for r in ("r", "q") for i, p in enumerate(paths)] + [(None, "x/f.py", "a"), ("r", None, "b"), ("s", "a.py", "alone")]
    df = spark.createDataFrame(rows, "repo_name string, path string, content string")
    got = samples.files_with_contexts(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (most > 0) and "Window" not in plan and "Aggregate" not in plan
    want = samples.with_contexts(df, samples.cross_file_context(df))
    key = lambda r: (str(r[0]), str(r[1]))
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_texts_are_not_sorted_to_meet_labels(spark, monkeypatch, tmp_path, most):
    """Beyond Spark's limit for broadcasts, contents were sorted by id to meet labels, and by path to meet the names of heads; repeated and null labels count as in SQL."""
    monkeypatch.setattr(views, "BROADCAST_LABELS", most)
    monkeypatch.setattr(samples, "BROADCAST_NAMES", most)
    docs = [(i, None if i == 9 else f"text {i}\n", "en", "web", 7) for i in range(0, 200, 3)] + [(None, "no id", "en", "web", 5)]
    marks = [(i, 1, i // 6 % 2) for i in range(0, 150, 6)] + [(12, 0, 1), (12, 0, None), (None, 1, 1), (500, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plans = []
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    keep = samples.materialise
    monkeypatch.setattr(samples, "materialise", lambda df, name: plans.append(planned(df)) or keep(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = views.repo_files(spark, str(tmp_path))
        assert "SortMergeJoin" not in planned(files) and ("BroadcastHashJoin" if most else "ShuffledHashJoin") in planned(files)
        got = sorted((r["doc_id"] or -1, r["content"], r["is_generated"]) for r in files.select("doc_id", "content", "is_generated").collect())
        context = catalog.QUERIES["cross_file_context"](spark, str(tmp_path))
        # The lists alone, which hold the heads that are shown, may be joined by sorting.
        assert [p.count("SortMergeJoin") for p in plans] == [0, 0, 1]
        shown = {(r["path"], r["rank"], r["context_path"], r["context_text"]) for r in context.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted((i or -1, t or "", toxic == 1) for i, t, *_ in docs for toxic in [x for k, _, x in marks if k is not None and k == i] or [None])
    assert got == want
    path = lambda i: f"{['src', 'tests', 'docs', 'pkg'][i // 20 % 4]}/f{i}{'.md' if i // 20 % 5 == 0 else '.py'}"
    head = {path(i): t or "\n" for i, t, *_ in docs if i is not None}
    # Document 12, in src, has three rows, so its path is not unique there.
    for p in (p for p in head if not p.startswith("src/")):
        near = sorted(x for x in head if x != p and x.startswith(p.split("/")[0] + "/"))[:5]
        assert {(n, x, t) for q, n, x, t in shown if q == p} == {(n, x, head[x]) for n, x in enumerate(near, 1)}


def test_function_rounds(spark):
    code = "import os\n\ndef a():\n    return 1\n\ndef b():\n    return 2\n"
    df = spark.createDataFrame([(1, code), (2, "abc"), (3, "")], "id long, text string")
    rows = splitter.function_rounds(df).orderBy("id", "round").collect()
    assert len(rows) == 15
    for r in rows:
        prefix, middle, suffix = {1: (code[:11], code[11:34], code[34:]), 2: ("a", "bc", ""), 3: ("", "", "")}[r["id"]]
        parts, at = [], 0
        for i in range(6):
            size = len(middle) // 6 + (i < len(middle) % 6)
            parts.append(middle[at : at + size])
            at += size
        assert (r["prefix"], r["suffix"]) == (prefix, suffix) and r["middle"] == "".join(parts[: r["round"] + 2])
