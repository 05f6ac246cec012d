"""Hand-derived cases and properties of the engine's operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace import config as C
from millrace.functions import similarity as S
from millrace.functions import text as T
from millrace.operators import decontamination as D
from millrace.operators import evaluation as E
from millrace.operators import execution, fim, repos, samples, splitter
from millrace.sources import readers, writers


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], names).select(column.alias("r")).first()["r"]


def test_parse_bucket():
    assert repos.parse_buckets(["0.5-1:10"]) == [(524288, 1048576, 10485760)]


@pytest.mark.parametrize(
    "row, want",
    [((0.8, 30, True, True, True, "Python", 10, 0), 139.193686), ((0.5, 45, False, False, False, "C", 0, 4), 62.218876)],
)
def test_score(spark, row, want):
    names = "core_py_ratio double, core_py_files long, has_config boolean, has_src boolean, has_init boolean, gha_language string, stars long, forks long"
    got = spark.createDataFrame([row], names).select(repos.score().alias("s"), repos.score_reason().alias("r")).first()
    assert got["s"] == pytest.approx(want, abs=1e-6)
    if row[5] == "Python":
        assert got["r"] == "core_ratio=0.80 ;core_py>=25 ;config ;src/lib ;init ;gha=py"


def test_names_and_paths(spark):
    df = spark.createDataFrame([("owner/repo.git",), ("///",), ("a b/c--",)], ["x"])
    assert [r[0] for r in df.select(T.sanitize_dirname(F.col("x"))).collect()] == ["owner_repo.git", "repo", "a_b_c"]
    assert one(spark, T.safe_relpath(F.col("x")), x="/../a/../../b..") == "__UP__/a/__UP__/__UP__/b.."
    assert one(spark, T.relative_path(F.col("x"), F.lit("/r/o")), x="/r/o/a/b.py") == "a/b.py"


def test_file_predicate(spark):
    schema = "path string, is_vendor boolean, is_generated boolean, length_bytes long, max_line_length long, alphanum_fraction double"
    good = ("/src/a.py", None, False, 10, 80, 0.5)
    bad = [("", None, None, 10, 80, 0.5), ("a/.git/x", None, None, 10, 80, 0.5), ("a.PNG", None, None, 10, 80, 0.5), ("build/x.py", None, None, 10, 80, 0.5), ("x_pb2.py", None, None, 10, 80, 0.5)]
    bad += [("a.py", True, None, 10, 80, 0.5), ("a.py", None, None, None, 80, 0.5), ("a.py", None, None, 10, None, 0.5), ("a.py", None, None, 10, 80, None), (None, None, None, 10, 80, 0.5)]
    got = [r[0] for r in spark.createDataFrame([good, *bad], schema).select(repos.is_text_candidate()).collect()]
    assert got == [True] + [False] * len(bad)


def test_parts(spark):
    assert one(spark, splitter.parts_of(F.col("x"), 3), x="abcdefg") == ["abc", "de", "fg"]
    assert one(spark, splitter.growing(F.col("x"), 2), x="abcdefg") == ["abcde", "abcdefg"]
    df = spark.createDataFrame([("x" * 70,)], ["t"])
    out = splitter.efim_rounds(df, "t").orderBy("round").collect()
    assert [(len(r["prefix"]), 5 + len(r["middle"]), len(r["suffix"])) for r in out] == [(5, e, 35) for e in (10, 15, 20, 25, 30)]


@pytest.mark.parametrize("n, c, k, want", [(5, 2, 2, 0.7), (5, 0, 1, 0), (3, 3, 2, 1), (1, 0, 1, 0), (1, 1, 1, 1)])
def test_pass_rate(spark, n, c, k, want):
    assert one(spark, E.pass_rate(F.col("n"), F.col("c"), k), n=n, c=c) == pytest.approx(want)


def test_truncation_to_two_decimals(spark):
    assert one(spark, T.truncate_2dp(F.col("x")), x=80.5999) == 80.59


def test_label_mask_and_padding(spark):
    assert one(spark, fim.label_mask(F.col("x"), F.lit(9)), x=[1, 2, 9, 3, 4]) == [-100, -100, -100, 3, 4]
    assert one(spark, fim.label_mask(F.col("x"), F.lit(7)), x=[1, 2]) == [1, 2]
    df = spark.createDataFrame([(1, [1, 2, 3], [1, 2, 3]), (2, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5])], "id long, input_ids array<int>, labels array<int>")
    a, b = fim.pad_batches(df, "id").orderBy("id").collect()
    assert a["labels"] == [1, 2, 3, -100, -100] and a["attention_mask"] == [1, 1, 1, 0, 0] and b["attention_mask"] == [1] * 5 and a["input_ids"] == [1, 2, 3, 0, 0]


def test_label_mask_takes_linear_time(spark):
    """The middle is sought once a text: before, each of these 300,000 ids sought it anew."""
    ids = F.concat(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: i % 7), F.array(F.lit(9), F.lit(3)))
    began = time.monotonic()
    got = spark.range(1).select(fim.label_mask(ids, F.lit(9)).alias("x")).select(F.size("x"), F.slice("x", -3, 3)).first()
    assert (got[0], got[1]) == (300_002, [-100, -100, 3]) and time.monotonic() - began < 20
    assert one(spark, fim.label_mask(F.col("x"), F.lit(None).cast("int")), x=[1, 2]) == [1, 2]
    assert one(spark, fim.label_mask(F.col("x"), F.lit(2)), x=[1, None, 2]) == [-100, -100, -100]


@pytest.mark.parametrize("most", [500_000, 0])
def test_batches_are_planned_without_their_ids(spark, monkeypatch, most):
    """Whole rows were sorted and windowed before. A null key stays; where a key stands twice no row is lost or doubled."""
    monkeypatch.setattr(fim, "BROADCAST_ROWS", most)
    rows = [(None if i == 3 else i, [i] * (i % 5), [i] * (i % 5)) for i in range(10)]
    kind = "id long, input_ids array<int>, labels array<int>"
    got = fim.pad_batches(spark.createDataFrame(rows, kind), "id")
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    sizes = [max(len(r[1]) for r in order[k : k + 4]) for k in (0, 4, 8)]
    want = {(r[0], k // 4, tuple(r[1]) + (0,) * (sizes[k // 4] - len(r[1]))) for k, r in enumerate(order)}
    assert {(r["id"], r["batch_id"], tuple(r["input_ids"])) for r in got.collect()} == want
    twice = fim.pad_batches(spark.createDataFrame(rows + rows[:1] * 2, kind), "id").collect()
    assert len(twice) == 12 and sorted(r["batch_id"] for r in twice) == [0] * 4 + [1] * 4 + [2] * 4


def test_row_numbers(spark):
    got = fim.with_row_number(spark.range(0, 1000, 7).repartition(5), "id", 8).orderBy("id").collect()
    assert [r["row_number"] for r in got] == list(range(len(got)))
    assert fim.with_row_number(spark.range(0), "id").count() == 0


def test_prompts(spark):
    s = C.Sentinels("P", "M", "S")
    cols = F.lit("a"), F.lit("b"), F.lit("c")
    assert one(spark, fim.prompt_fim(*cols, s)) == "PabScM"
    assert one(spark, fim.prompt_efim(*cols, s)) == "PaScMb"
    assert fim.sentinels_of("Qwen2.5-Coder").pre == "<|fim_prefix|>"
    with pytest.raises(ValueError):
        fim.sentinels_of("other")
    got = one(spark, fim.split_prompt(F.lit("PxScMy"), s))
    assert (got["prefix"], got["middle"], got["suffix"]) == ("x", "y", "c")
    assert one(spark, fim.split_prompt(F.lit("PPxScMy"), s)) is None


@pytest.mark.parametrize(
    "prefix, suffix, want",
    [
        ("import os\ndef f(x):\n    y = ", "x\n    return y\n\nclass C:\n    pass\n", ("import os\n", "def f(x):\n    y = ", "x\n    return y\n\n", "class C:\n    pass\n")),
        ("a\ndef f():\n  x=", "\n  return x\ndef g():\n  pass\n", ("a\n", "def f():\n  x=", "\n  return x\n", "def g():\n  pass\n")),
        ("", "", ("", "", "", "")),
        ("x = 1\n  async def g():\n", "no mark", ("x = 1\n", "  async def g():\n", "no mark", "")),
        ("a def b", "@c\nd", ("", "a def b", "", "@c\nd")),
    ],
)
def test_function_parts(spark, prefix, suffix, want):
    parts = fim.function_parts(F.col("p"), F.col("s"))
    row = spark.createDataFrame([(prefix, suffix)], ["p", "s"]).select(*[x.alias(str(i)) for i, x in enumerate(parts)]).first()
    assert tuple(row) == want


def test_training_prompts_hold_each_part_once(spark):
    rng = random.Random(1)
    rows = [(i, f"f{i}.py", "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 80)))) for i in range(60)]
    out = fim.training_prompts(spark.createDataFrame(rows, "id long, path string, content string"), F.col("id")).collect()
    whole = {i: f"<|file_sep|>{p}\n{c}" for i, p, c in rows}
    for r in out:
        marks = "<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>", "<|endoftext|>"
        bare = r["prompt"]
        for m in marks:
            bare = bare.replace(m, "")
        assert sorted(bare) == sorted(whole[r["id"]])
    assert {r["mode"] for r in out} == {"l2r", "fim", "sfim"}


def plain_blocks(code):
    """Spans of function blocks, each header on its own."""
    lines, at = [], 0
    for line in code.splitlines(keepends=True):
        lines.append((at, len(line) - len(line.lstrip(" \t")), line.lstrip(" \t"), not line.strip()))
        at += len(line)
    spans = []
    for i, (at, indent, bare, _) in enumerate(lines):
        if bare.startswith(("def ", "async def ")):
            k = i
            while k and lines[k - 1][1] == indent and lines[k - 1][2].startswith("@"):
                k -= 1
            spans.append((lines[k][0], next((x[0] for x in lines[i + 1 :] if not x[3] and x[1] <= indent), len(code))))
    return spans


def plain_parts(code):
    spans = plain_blocks(code)
    inner = [s for s in spans if s[0] > 0 and s[1] < len(code)]
    a, b = min(inner or spans or [(len(code) // 2, len(code))], key=lambda s: abs(s[0] + s[1] - len(code)))
    return code[:a], code[a:b], code[b:]


def test_blocks(spark):
    code = "import os\n\n@dec\ndef a():\n    return 1\n\ndef b():\n    return 2\n"
    nested = "def a():\n  def b():\n    x\n  y\nz\n"
    assert plain_blocks(code) == [(11, 39), (39, 61)] and plain_blocks(nested) == [(0, 30), (9, 26)]
    assert plain_parts(code) == (code[:11], code[11:39], code[39:]) and plain_parts("abc") == ("a", "bc", "")
    rng = random.Random(5)
    pieces = ["def f():", "async def g(x):", "@dec", "x = 1", "", "  ", "class C:", "\t# é", "\x1f", "\u2003", "defx", "@"]
    ends = ["\n", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\u2028"]
    texts = [code, nested, "", "abc", "@a\n @b\n@c\ndef f(): pass", None]
    texts += ["".join(rng.choice(["", "", "  ", "    ", "\t"]) + rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randint(1, 25)))[: rng.choice([None, -1])] for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = splitter.split_functions(df)
    for r in out.select("text", "prefix", "middle", "suffix", splitter.function_blocks(F.col("text")).alias("blocks")).collect():
        if r["text"] is None:
            assert tuple(r) == (None,) * 5
        else:
            assert [tuple(x) for x in r["blocks"]] == plain_blocks(r["text"]), repr(r["text"])
            assert tuple(r)[1:4] == plain_parts(r["text"]), repr(r["text"])
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        splitter.check_language("java")


def test_edit_similarity(spark):
    assert S.indel_ratio("kitten", "sitting") == 62 and S.indel_ratio("", "") == 100 and S.indel_ratio("a", "") == 0 and S.indel_ratio("ab", "ab") == 100

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out

    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert S.indel_ratio(a, b) == round(200 * lcs(a, b) / (len(a) + len(b)))
    assert one(spark, S.edit_similarity(F.lit(" ab\n"), F.lit("ab"))) == 100.0


def test_lines_and_tokens(spark):
    for text in ("", "\n", "a\nb\n", "a\r\nb\x0bc\u2028d", "x\n\n"):
        assert one(spark, T.split_lines(F.col("x")), x=text) == text.splitlines()
    assert one(spark, T.truncate_tokens(F.col("x"), F.lit(3)), x="ab 12,  cd e") == "ab 12,"
    assert one(spark, T.count_tokens(F.col("x")), x="ab 12,  cd é") == 5
    assert one(spark, T.word_ngrams(F.col("x"), 2), x=" a b  c ") == [["a", "b"], ["b", "c"]]


def test_decontamination_splits_the_input(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words))), (3, None), (None, "x " + " ".join(words[5:20])), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words[3:18])), (2, None)], "item_id long, text string")
    assert {r[0] for r in D.contaminated(docs, bench).collect()} == {1, None}
    assert {r[0] for r in D.decontaminate(docs, bench).collect()} == {2, 3, 4}
    assert D.decontaminate(docs, bench.limit(0)).count() == 5
    # A large index is joined by shuffling, with the same result.
    assert {r[0] for r in D.contaminated(docs, bench, filter_bytes=64).collect()} == {1, None}


def test_cross_file_budget(spark):
    files = [("r", f"a/f{i}.py", "word " * (40 * i)) for i in range(6)] + [("r", "a/b/g.py", "x"), ("r", "ab/h.py", "x"), ("r", "top.py", "x"), ("q", "a/f9.py", "x")]
    df = spark.createDataFrame(files, "repo_name string, path string, content string")
    out = samples.cross_file_context(df).collect()
    by = {}
    for r in out:
        by.setdefault((r["repo_name"], r["path"]), []).append(r)
    assert all(r["running"] <= 512 and r["rank"] <= 5 and r["context_path"] != r["path"] for r in out)
    assert [r["context_path"] for r in sorted(by["r", "a/f0.py"], key=lambda r: r["rank"])][:2] == ["a/b/g.py", "a/f1.py"]
    assert "top.py" not in {r["context_path"] for r in by["r", "a/f0.py"]} and ("q", "a/f9.py") not in by
    literal = {r["context_path"] for r in samples.cross_file_context(df, literal_prefix=True).where("path = 'a/b/g.py'").collect()}
    plain = {r["context_path"] for r in samples.cross_file_context(df).where("path = 'a/b/g.py'").collect()}
    assert plain <= literal


def test_budgeted_pick(spark):
    rows = [(0, i, f"o{i % 2}/r{i}", f"o{i % 2}", 100.0 - i, 600) for i in range(1, 9)] + [(1, 1, "x/y", "x", 50.0, 10 * C.MB)]
    df = spark.createDataFrame(rows, "bucket int, rank int, repo_name string, owner string, score double, total_bytes long")
    got = repos.budgeted_pick(df, [(0, 1000, 5000), (1000, 10**9, 10**9)], C.RepoConfig(target_total_mb=1)).collect()
    assert len(got) == 2 and {r["owner"] for r in got} == {"o0", "o1"}


def test_gaps_and_scrape(spark):
    lines = [(1, 0, 1.0, 0.5, 'data: {"choices": [{"text": "a"}]}'), (1, 1, 1.5, 0.5, ""), (1, 2, 2.0, 0.5, 'data: {"choices": [{"text": "b"}]}'), (1, 3, 2.1, 0.5, "data: [DONE]"), (1, 4, 9.0, 0.5, "data: x")]
    chunks = E.sse_chunks(spark.createDataFrame(lines, "request_id long, seq long, ts double, start_ts double, line string"))
    got = E.gaps_from_chunks(chunks).first()
    assert (got["ttft"], got["itl"], got["generated_text"], got["latency"]) == (0.5, [1.0], "ab", 1.5)
    page = spark.createDataFrame([(0, 'hits{a="1"} 3'), (1, 'hits{a="1"} 5'), (2, "# x")], "line_no int, line string")
    assert E.scrape_counters(page, ["hits"]).first()[0] == 5.0


def test_execution_is_off_by_default(spark):
    df = spark.createDataFrame([(1, 0, "assert 1 == 1"), (1, 1, "assert False"), (2, 0, "while True: pass")], "task_id long, completion_id int, program string")
    with pytest.raises(PermissionError):
        execution.check_correctness(df)
    got = {(r[0], r[1]): r[3] for r in execution.check_correctness(df, 1.0, allow_untrusted_code=True).collect()}
    assert got[1, 0] == "passed" and got[1, 1].startswith("failed: ") and got[2, 0] == "timed out"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"prompt": "a", "groundtruth": "b", "right_context": "c"}\n\nnot json\n')
    assert readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), readers.COMPLETION_PROBLEMS).count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), readers.COMPLETION_PROBLEMS, strict=True).collect()
    df = spark.createDataFrame([("é\u2028x", 1)], "content string, n int")
    writers.write_jsonl(df, str(tmp_path / "out"), gzip=True)
    assert readers.read_jsonl(spark, str(tmp_path / "out"), "content string, n int").first()["content"] == "é\u2028x"
    (tmp_path / "tree/r1/sub").mkdir(parents=True)
    (tmp_path / "tree/r1/sub/a.py").write_bytes(b"ok\xff\xfe")
    (tmp_path / "tree/r1/b.txt").write_text("no")
    got = readers.read_source_tree(spark, str(tmp_path / "tree")).collect()
    assert [(r["repo_name"], r["path"], r["content"]) for r in got] == [("r1", "sub/a.py", "ok")]
    with pytest.raises(ValueError):
        readers.read_benchmark(spark, str(tmp_path), "nothing")


def test_blobs(spark):
    import gzip

    rows = [(1, gzip.compress(b"hello"), "utf-8"), (2, gzip.compress(b"a\x00b"), None), (3, b"no gzip", None), (4, gzip.compress("é".encode("latin-1")), "iso-8859-1"), (5, gzip.compress(b"\xff"), "utf-8"), (6, gzip.compress(b""), None)]
    blobs = spark.createDataFrame([(i, bytearray(b), e) for i, b, e in rows], "id long, content binary, src_encoding string")
    got = readers.valid_blobs(readers.gunzip_blobs(blobs)).collect()
    assert {(r["id"], r["text"]) for r in got} == {(1, "hello"), (4, "é")}


def test_config():
    cfg = C.Config.from_mapping({"fim": {"fim_rate": 0.8}})
    assert cfg.fim.fim_rate == 0.8 and cfg.repo.min_core_files == 25
    with pytest.raises(ValueError):
        C.Config.from_mapping({"x": {}})


def test_sample_of_the_whole_table(spark):
    df = spark.range(200).repartition(7)
    got = [r["id"] for r in samples.sample_without_replacement(df, 15, F.col("id"), 5).collect()]
    draw = lambda k: (k % 2147483648 * 1103515245 + 12345 + 5) % 2147483648
    assert got == sorted(range(200), key=lambda k: (draw(k), k))[:15]
    assert samples.sample_without_replacement(df, 500, F.col("id"), 5).count() == 200


def test_shortlist_is_in_order(spark):
    from millrace.plans import catalog

    rows = [(r["bucket"], r["rank"]) for r in catalog.QUERIES["shortlist_sort"](spark, "/root/testdata/sf0.01").collect()]
    assert rows == sorted(rows) and len(rows) > 5


def test_budgeted_pick_step_by_step(spark):
    """The fold of a shortlist, followed with the same draws: quotas, owners, overshoot and failed checks."""
    rows = [(b, i, f"o{i % 4}/r{b}{i}", f"o{i % 4}", 100.0 - i, 900_000 + 50_000 * i, 800_000 + 40_000 * i, i % 5 != 3) for b in range(2) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "bucket int, rank int, repo_name string, owner string, score double, total_bytes long, actual_bytes long, passed boolean")
    cfg = C.RepoConfig(target_total_mb=6, max_repos_per_owner=2, random_top_k=3, overshoot_bytes=100_000)
    rng, owners, total, want = random.Random(9), {}, 0, []
    for b, quota in enumerate((3_000_000, 9_000_000)):
        left, spent = [r for r in rows if r[0] == b], 0
        while left and spent < quota and total < 6 * C.MB:
            r = left.pop(rng.randrange(min(3, len(left))))
            if owners.get(r[3], 0) < 2 and total + r[5] <= 6 * C.MB + 100_000 and r[7]:
                owners[r[3]] = owners.get(r[3], 0) + 1
                spent, total = spent + r[6], total + r[6]
                want.append((b, r[2], r[6]))
    got = [(r["bucket"], r["repo_name"], r["bytes"]) for r in repos.budgeted_pick(df, [(0, 1, 3_000_000), (1, 2, 9_000_000)], cfg, seed=9).orderBy("pick").collect()]
    assert got == want and len(got) >= 5
