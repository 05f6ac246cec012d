"""Registered queries of the engine's own operators: thin plans over the operators and the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import config as C
from millrace.functions import similarity as S
from millrace.functions import text as T
from millrace.operators import decontamination as D
from millrace.operators import evaluation as E
from millrace.operators import fim, repos, samples, splitter
from millrace.plans import views as V
from millrace.plans.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(name: str):
    return F.round(name, 6).alias(name)


@query
def decontaminate_ngrams(spark: SparkSession, d: str) -> DataFrame:
    kept = D.decontaminate(V.table(spark, d, "documents"), V.table(spark, d, "benchmark"))
    return kept.select("doc_id", "lang", "source", "n_chars")


@query
def contaminated_docs(spark, d):
    return D.contaminated(V.table(spark, d, "documents"), V.table(spark, d, "benchmark"))


@query
def ngram_index(spark, d):
    return D.ngram_index(V.table(spark, d, "benchmark"))


@query
def benchmark_union(spark, d):
    text, third = F.col("text"), F.floor(F.length("text") / 3).cast("int")
    lines = V.table(spark, d, "benchmark").select(
        F.substring(text, F.lit(1), third).alias("prompt"), F.substring(text, third + 1, third).alias("groundtruth"), F.substring(text, 2 * third + 1, F.length(text)).alias("right_context")
    )
    infilling = V.documents(spark, d).select(F.lit("").alias("prompt"), F.col("text").alias("canonical_solution"), F.lit("").alias("suffix"))
    return D.sample_text(lines, infilling)


@query
def text_candidates(spark, d):
    return V.repo_files(spark, d).where(repos.is_text_candidate()).select("doc_id", "path")


@query
def char_length_band(spark, d):
    return V.table(spark, d, "documents").where(samples.in_length_band(F.col("text"))).select("doc_id", "n_chars")


def _stats(spark, d):
    return repos.repo_stats(V.repo_files(spark, d, with_content=False), V.eligible())


def _scored(spark, d):
    return repos.scored(_stats(spark, d), V.BUCKETS)


def _admitted(spark, d):
    return _scored(spark, d).where(repos.is_admitted(V.SMALL))


@query
def reject_reason_funnel(spark, d):
    return _scored(spark, d).groupBy(F.coalesce(repos.reject_reason(V.SMALL), F.lit("admitted")).alias("reason")).agg(F.count("*").alias("repos"))


@query
def admission_filter(spark, d):
    return _admitted(spark, d).select("repo_name", "bucket", _r("score"))


@query
def postcheck_repo(spark, d):
    return repos.postcheck(V.repo_files(spark, d, with_content=False), C.RepoConfig(post_min_py_mb=2048 / C.MB))


@query
def owner_counts(spark, d):
    return repos.owner_counts(_admitted(spark, d))


@query
def shortlist_sort(spark, d):
    return repos.bucket_topk(_admitted(spark, d), 500, F.lit(0)).orderBy("bucket", "rank").select("repo_name", "bucket", "rank")


@query
def buckets_parsed(spark, d):
    """Documents by size bucket, the buckets parsed from their text form."""
    parsed = repos.parse_buckets(["0.0009765625-0.00390625:1", "0.00390625-0.03125:2", "0.03125-1:4"])
    buckets = spark.createDataFrame([(i, *b) for i, b in enumerate(parsed)], "bucket int, lo int, hi int, quota int")
    sized = repos.bucket_join(V.table(spark, d, "documents").select("doc_id", "n_chars"), buckets, "n_chars").where("bucket is not null")
    return sized.groupBy("bucket", "lo", "hi", "quota").agg(F.count("*").alias("documents"))


@query
def junk_names(spark, d):
    names = V.table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/"), F.lower(F.regexp_extract("text", r"^(\w+)", 1)), F.lit("-"), F.when(F.col("doc_id") % 3 == 0, "Demo").when(F.col("doc_id") % 3 == 1, "demonstrate").otherwise("x_TUTORIAL.v2")).alias("name"))
    return names.select("doc_id", repos.is_junk_name(F.col("name")).alias("junk"), F.concat_ws(" ", repos.name_tokens(F.col("name"))).alias("tokens"))


@query
def repo_stats(spark, d):
    return _stats(spark, d).select("repo_name", "owner", "has_src", "total_bytes", "core_bytes", "core_py_bytes", "core_py_files", "eligible_files", _r("core_py_ratio"))


@query
def repo_score(spark, d):
    return _scored(spark, d).select("repo_name", _r("score"), "reason")


@query
def repo_bucket(spark, d):
    buckets = spark.createDataFrame([(i, lo, hi) for i, (lo, hi, _) in enumerate(V.BUCKETS)], "bucket int, lo int, hi int")
    return repos.bucket_join(_stats(spark, d).select("repo_name", "total_bytes"), buckets, "total_bytes")


@query
def bucket_topk(spark, d):
    return repos.bucket_topk(_scored(spark, d), 3, F.lit(0)).select("repo_name", "bucket", "rank")


@query
def scan_early_stop(spark, d):
    return repos.scan_stop(_scored(spark, d), 2, len(V.BUCKETS), "repo_name")


@query
def budgeted_pick(spark, d):
    short = repos.bucket_topk(_admitted(spark, d), 500, F.lit(0))
    return repos.budgeted_pick(short, V.BUCKETS, C.RepoConfig(max_repos_per_owner=5), seed=42)


@query
def sanitize_names(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.sanitize_dirname(F.col("url")).alias("name"))


@query
def safe_paths(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.safe_relpath(F.replace("url", F.lit("/en"), F.lit("/.."))).alias("path"))


@query
def token_counts(spark, d):
    return V.documents(spark, d).select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@query
def truncate_to_budget(spark, d):
    files = V.repo_files(spark, d).select("doc_id", "repo_name", "path", "content")
    return samples.truncate_samples(files).select("doc_id", "content_length", "total_length", "content")


@query
def corpus_metrics(spark, d):
    files = V.repo_files(spark, d).select("repo_name", "path", "content")
    m = samples.corpus_metrics(samples.truncate_samples(files))
    return m.select(*[_r(c) if c.startswith("average") else F.col(c) for c in m.columns])


@query
def filtered_metrics(spark, d):
    """Corpus metrics of the samples that share no n-gram with the benchmark."""
    files = V.repo_files(spark, d).select("doc_id", "repo_name", "path", "content")
    clean = D.decontaminate(files, V.table(spark, d, "benchmark"), text_col="content")
    m = samples.corpus_metrics(samples.truncate_samples(clean))
    return m.select(*[_r(c) if c.startswith("average") else F.col(c) for c in m.columns])


@query
def repo_sample_totals(spark, d):
    return samples.repo_totals(samples.truncate_samples(V.repo_files(spark, d).select("repo_name", "path", "content")))


@query
def token_band(spark, d):
    n = T.count_tokens(F.col("text"))
    rows = V.documents(spark, d).select("doc_id", n.alias("tokens"))
    short, long = samples.in_token_band(F.col("tokens"), None, 2048), samples.in_token_band(F.col("tokens"), 2048, 4096)
    return rows.where(short | long).select("doc_id", "tokens", short.alias("short"), long.alias("long"))


def _plain_files(spark, d):
    return V.repo_files(spark, d).select("repo_name", "path", "content")


@query
def cross_file_context(spark, d):
    return samples.cross_file_context(_plain_files(spark, d))


@query
def cross_file_context_literal(spark, d):
    """Neighbours by plain prefix, in folders of which one name begins another's."""
    path = F.when(F.col("doc_id") % 3 == 0, F.replace("path", F.lit("/f"), F.lit("_more/f"))).otherwise(F.col("path"))
    files = V.repo_files(spark, d).select("repo_name", path.alias("path"), "content")
    return samples.cross_file_context(files, literal_prefix=True)


@query
def intra_cross_ratio(spark, d):
    out = samples.intra_cross_ratio(samples.files_with_contexts(_plain_files(spark, d)))
    return out.select("intra_tokens", "cross_tokens", _r("intra_percent"))


@query
def fim_character(spark, d):
    cut = fim.split_characters(V.documents(spark, d).select("doc_id", "text"), F.col("text"), F.col("doc_id"))
    return cut.select("doc_id", F.coalesce(fim.prompt_efim(F.col("prefix"), F.col("middle"), F.col("suffix")), "text").alias("prompt"))


@query
def fim_token(spark, d):
    return fim.split_token_text(V.documents(spark, d).select("doc_id", "text"), F.col("text"), F.col("doc_id")).select("doc_id", "prefix", "middle", "suffix")


@query
def mode_router(spark, d):
    return V.table(spark, d, "documents").select("doc_id", fim.training_mode(F.col("doc_id")).alias("mode"))


@query
def training_prompts(spark, d):
    files = V.repo_files(spark, d).select("doc_id", "path", "content")
    return fim.training_prompts(files, F.col("doc_id")).select("doc_id", "mode", "prompt")


@query
def label_mask(spark, d):
    ids = V.documents(spark, d).select("doc_id", V.tokens_hashed(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.array_join(fim.label_mask(F.col("ids"), F.lit(1012)), ",").alias("labels"))


@query
def pad_batch(spark, d):
    whole = V.documents(spark, d).select("doc_id", V.tokens_hashed(F.col("text")).alias("input_ids"))
    out = fim.pad_batches(whole.withColumn("labels", F.col("input_ids")), "doc_id")
    return out.select("doc_id", "batch_id", *[F.array_join(c, ",").alias(c) for c in ("input_ids", "labels", "attention_mask")])


def _pms():
    return F.col("prefix"), F.col("middle"), F.col("suffix")


@query
def prompt_fim(spark, d):
    return V.problems(spark, d).select("doc_id", fim.prompt_fim(*_pms()).alias("prompt"))


@query
def prompt_efim(spark, d):
    return V.problems(spark, d).select("doc_id", fim.prompt_efim(*_pms()).alias("prompt"))


@query
def prompt_sfim(spark, d):
    text, third = F.col("text"), F.floor(F.length("text") / 3).cast("int")
    parts = V.code(spark, d).select("doc_id", F.substring(text, F.lit(1), third).alias("prefix"), F.substring(text, third + 1, third).alias("middle"), F.substring(text, 2 * third + 1, F.length(text)).alias("suffix"))
    return parts.select("doc_id", fim.prompt_sfim(*_pms()).alias("prompt"))


@query
def function_split(spark, d):
    return splitter.split_functions(V.code(spark, d)).drop("text")


@query
def rounds_efim(spark, d):
    out = splitter.efim_rounds(V.documents(spark, d).select("doc_id", "text"), "text")
    return out.select("doc_id", "round", "prefix", "middle", "suffix")


@query
def rounds_function(spark, d):
    return splitter.function_rounds(V.code(spark, d)).select("doc_id", "round", "prefix", "middle", "suffix")


@query
def rounds_k_parts(spark, d):
    return splitter.middle_rounds(V.problems(spark, d)).select("doc_id", "round", "middle")


@query
def ground_truth_span(spark, d):
    out = splitter.ground_truth_span(V.documents(spark, d).select("doc_id", "text"), "text", F.col("doc_id"))
    return out.select("doc_id", "prefix", "typed", "groundtruth", "suffix")


@query
def prompt_cut(spark, d):
    return splitter.prompt_cut(V.documents(spark, d).select("doc_id", "text"), "text", F.col("doc_id")).select("doc_id", "prefix", "typed")


@query
def mode_split_cross(spark, d):
    # Nine rows of settings, whatever the corpus.
    modes = spark.createDataFrame([(m, s) for m in ("fim", "efim", "sfim") for s in ("efim", "function", "cceval")], "mode string, split string")
    sized = V.problems(spark, d).agg(F.count("*").alias("prompts"), F.sum(F.length("prefix") + F.length("middle")).alias("chars"))
    return modes.crossJoin(F.broadcast(sized))


@query
def line_split(spark, d):
    return V.documents(spark, d).select("doc_id", splitter.line_split(F.col("text"), F.lit(1)).alias("s")).select("doc_id", "s.before", "s.current", "s.after")


def _neighbours(spark, d):
    """Each completion and the next of its task: truth and prediction."""
    rows = V.completions(spark, d)
    after = rows.select("task_id", (F.col("completion_id") - 1).alias("completion_id"), F.col("completion").alias("prediction"))
    return rows.withColumnRenamed("completion", "groundtruth").join(after, ["task_id", "completion_id"])


@query
def exact_match(spark, d):
    return E.match_rates(_neighbours(spark, d), ["role"], with_edit=False).select("role", "count", _r("em"))


@query
def edit_similarity(spark, d):
    return E.match_rates(_neighbours(spark, d), ["role"]).select("role", "count", _r("em"), _r("es"))


@query
def pass_at_k(spark, d):
    return E.task_pass(V.completions(spark, d), [1, 2]).select("task_id", "n", "c", _r("pass_at_1"), _r("pass_at_2"))


@query
def pass_at_k_mean(spark, d):
    return E.pass_at_k(V.completions(spark, d), [1, 2]).select(_r("pass_at_1"), _r("pass_at_2"))


@query
def problem_dictionary(spark, d):
    return E.problem_dictionary(V.completions(spark, d), "completion_id").select("task_id", "completion_id", "completion")


@query
def join_problems(spark, d):
    """Completions with the first and the last turn of their own task."""
    rows = V.completions(spark, d)
    last = E.problem_dictionary(rows, "completion_id").select("task_id", F.col("role").alias("last_role"), F.col("completion").alias("last_text"))
    return E.join_problems(rows.select("task_id", "completion_id", "role"), last).select("task_id", "completion_id", "role", "last_role", "last_text")


@query
def unattempted(spark, d):
    return E.unattempted(V.table(spark, d, "documents").select(F.col("doc_id").alias("task_id")), V.completions(spark, d))


@query
def attach_results(spark, d):
    """All turns with the results of those that were run, the assistant's."""
    rows = V.completions(spark, d)
    ran = rows.where("role = 'assistant'").select("task_id", "completion_id", "passed", F.when(F.col("passed"), "passed").otherwise("failed").alias("result"))
    return E.attach_results(rows.select("task_id", "completion_id", "role"), ran).select("task_id", "completion_id", "role", "passed", "result")


@query
def completion_ordinal(spark, d):
    rows = V.table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), (F.col("turn") * 10 + 3).alias("arrived"))
    return E.with_completion_ordinal(rows, "arrived").select("task_id", "arrived", "completion_id")


@query
def replicate(spark, d):
    return samples.replicate(V.table(spark, d, "benchmark"), 3).select("item_id", "text", "completion_id")


@query
def assembled_results(spark, d):
    """Two result tables by mode, joined: latencies of requests, and lengths of what was asked and answered."""
    rows = V.requests(spark, d)
    one = rows.groupBy("mode").agg(F.avg("latency").alias("latency"), (100 * F.avg(F.col("success").cast("int"))).alias("success"))
    two = rows.where("success").groupBy("mode").agg(F.avg("prompt_len").alias("asked"), F.avg("output_len").alias("answered"))
    return E.assemble(one, two, ["latency", "success", "asked", "answered"])


@query
def levenshtein_similarity(spark, d):
    plain = V.table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("t"))
    after = plain.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return plain.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.levenshtein_similarity(F.col("t"), F.col("u")), 6).alias("similarity"))


@query
def check_program(spark, d):
    rows = V.completions(spark, d)
    test, entry = F.concat(F.lit("assert "), "role"), F.concat(F.lit("f"), F.col("task_id").cast("string"))
    return rows.select("task_id", "completion_id", E.check_program(F.lit("p"), F.col("completion"), F.lit("s"), test, entry).alias("program"))


@query
def success_filter(spark, d):
    return E.request_totals(V.requests(spark, d), 100.0, ["mode"]).select("mode", "requests", "completed", "total_output")


@query
def throughput(spark, d):
    m = E.request_totals(V.requests(spark, d), 100.0)
    return m.select("requests", "completed", "total_input", _r("request_throughput"), _r("input_throughput"), _r("output_throughput"))


@query
def latency_metrics(spark, d):
    m = E.latency_metrics(V.requests(spark, d), 100.0, ["mode"])
    return m.select("mode", *[_r(c) for c in m.columns if c.endswith("_ms")])


@query
def itl_from_chunks(spark, d):
    g = E.gaps_from_chunks(V.chunks(spark, d))
    total = F.aggregate("itl", F.lit(0.0), lambda a, x: a + x)
    return g.select("request_id", "ttft", F.size("itl").cast("long").alias("gaps"), total.alias("gap_sum"), "generated_text", "latency")


@query
def sse_chunks(spark, d):
    body = F.when(F.col("event_type") == "error", "data: [DONE]").when(F.col("event_type") == "view", " ").otherwise(F.concat(F.lit('data: {"choices": [{"text": "'), "event_type", F.lit('"}]}')))
    lines = V.table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("double").alias("ts"), F.lit(-1.0).alias("start_ts"), body.alias("line"))
    return E.sse_chunks(lines).select("request_id", "seq", "text")


@query
def cache_reuse(spark, d):
    view = F.col("event_type") == "view"
    sums = V.table(spark, d, "events").groupBy("user_id").agg(F.count_if(view).alias("queries"), F.count_if(view & (F.col("event_id") % 3 == 0)).alias("hits"))
    return sums.select("user_id", "queries", "hits", F.round(E.cache_reuse(F.col("hits"), F.col("queries")), 6).alias("reuse_percent"))


@query
def metric_scrape(spark, d):
    name = F.when(F.col("event_type") == "view", "queries_total").when(F.col("event_type") == "click", "hits_total").otherwise("other")
    lines = V.table(spark, d, "events").select("user_id", F.col("event_id").alias("line_no"), F.concat(name, F.lit('{engine="0"} '), F.col("event_id").cast("string")).alias("line"))
    return E.scrape_counters(lines, ["queries_total", "hits_total"], ["user_id"])


@query
def language_rollup(spark, d):
    even = (F.col("n_chars") % 2 == 0).cast("int")
    rates = V.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("count"), (100 * F.avg(even)).alias("em"))
    return E.report_with_overall(rates, "lang", "count", ["em"]).select("group", "count", _r("em"))


@query
def mode_pivot(spark, d):
    means = V.requests(spark, d).groupBy("mode").agg(F.avg("latency").alias("latency"), (100 * F.avg(F.col("success").cast("int"))).alias("success"))
    long = means.select("mode", F.expr("stack(2, 'latency', latency, 'success', success) as (metric, value)"))
    return E.mode_pivot(long, ["latency", "success"])


@query
def sample_without_replacement(spark, d):
    files = V.repo_files(spark, d, with_content=False).select("doc_id", "repo_name")
    return samples.sample_without_replacement(files, 3, F.col("doc_id"), 5, ["repo_name"])


@query
def sample_with_replacement(spark, d):
    files = V.repo_files(spark, d, with_content=False).select("doc_id", "repo_name")
    return samples.sample_with_replacement(files, 4, "repo_name", "doc_id", 6, F.col("doc_id"))
