"""The registered queries in DuckDB SQL, independent of the Spark plans."""

from __future__ import annotations

from millrace.config import END_MARKS, JUNK_TOKENS, START_MARKS

FILES = """
files as (select d.doc_id, concat(lang, '/', source) as repo_name,
    concat(case (d.doc_id // 20) % 4 when 0 then 'src' when 1 then 'tests' when 2 then 'docs' else 'pkg' end, '/f', d.doc_id, case when (d.doc_id // 20) % 5 = 0 then '.md' else '.py' end) as path,
    n_chars as length_bytes, coalesce(l.toxic, 0) = 1 as is_generated, coalesce(text, '') as content
  from documents d left join labels l on d.doc_id = l.doc_id)"""
OK = "(not is_generated and length_bytes between 1 and 2097152)"
TOK = "'[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]'"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {TOK})"


def n_tokens(x: str) -> str:
    return f"len({tokens(x)})"


SPANS = r"regexp_extract_all(text, '\s*(?:[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s])|\s+$')"
STATS = (
    FILES
    + f""",
marked as (select *, {OK} as ok, split_part(path, '/', 1) not in ('docs', 'tests') as core, path like '%.py' as py from files),
sums as (select repo_name, coalesce(sum(length_bytes) filter (ok), 0)::bigint as total_bytes, coalesce(sum(length_bytes) filter (ok and core), 0)::bigint as core_bytes,
    coalesce(sum(length_bytes) filter (ok and core and py), 0)::bigint as core_py_bytes, count(*) filter (ok and core and py) as core_py_files, count(*) filter (ok) as eligible_files,
    bool_or(path like 'src/%') as has_src
  from marked group by repo_name),
stats as (select *, case when core_bytes > 0 then core_py_bytes / core_bytes else 0.0 end as core_py_ratio, lower(split_part(repo_name, '/', 1)) as owner from sums where eligible_files > 0),
scored as (select *, 110 * core_py_ratio + case when core_py_files >= 40 then 12 when core_py_files >= 25 then 7 else 0 end + case when has_src then 8 else 0 end as score,
    case when total_bytes >= 1000 and total_bytes < 10000 then 0 when total_bytes >= 10000 and total_bytes < 50000 then 1 when total_bytes >= 50000 and total_bytes < 2000000 then 2 end as bucket
  from stats),
admitted as (select * from scored where core_py_ratio >= 0.55 and core_py_files >= 2 and total_bytes between 1 and 2097152 and bucket is not null and score >= 60)"""
)


def draw(key: str, salt: int) -> str:
    return f"(({key} % 2147483648) * 1103515245 + 12345 + {salt}) % 2147483648"


def between(key: str, salt: int, low: str, high: str) -> str:
    return f"(({low}) + ({draw(key, salt)}) // 65536 % (({high}) - ({low}) + 1))"


WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"


def grams(source: str, keep: str, text: str) -> str:
    w = WORDS.format(text)
    return f"select {keep} array_to_string(w[i:i + 9], ' ') as ngram from (select {keep} w, unnest(range(1, len(w) - 8)) as i from (select {keep} {w} as w from {source}) where len(w) >= 10)"


INDEX = f"idx as (select distinct ngram from ({grams('benchmark', '', 'text')}))"
HITS = f"{INDEX}, hits as (select distinct doc_id from ({grams('documents', 'doc_id, ', 'text')}) where ngram in (select ngram from idx))"
DOCS = "docs as (select doc_id, lang, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents)"
THIRDS = "p as (select doc_id, lang, text[1:n // 3] as prefix, text[n // 3 + 1:n // 3 * 2] as middle, text[n // 3 * 2 + 1:] as suffix from docs)"
PRE, MID, SUF = "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>"
CUT = f"""c1 as (select *, {between('doc_id', 1, '1', 'n - 5')} as a from t where n >= 10),
c2 as (select *, {between('doc_id', 2, 'a + 1', 'n - 1')} as b from c1)"""
REQ = "req as (select event_id as request_id, event_type as mode, event_type <> 'error' as success, coalesce(value, 0) as latency, coalesce(value, 0) / 5 as ttft, event_id % 100 as prompt_len, event_id % 7 as output_len, [coalesce(value, 0) / 10, coalesce(value, 0) / 20, coalesce(value, 0) / 40] as itl from events)"
COMP = "comp as (select conv_id as task_id, turn as completion_id, role, text as completion, length(text) % 2 = 0 as passed from conversations)"
R2 = "round({}, 6)"


def stat(v: str, name: str, where: str) -> str:
    parts = (("mean", f"avg({v})"), ("median", f"median({v})"), ("std", f"stddev_pop({v})"), ("p99", f"quantile_cont({v}, 0.99)"))
    return ", ".join(f"round(coalesce({f} filter ({where}) * 1000, 0), 6) as {k}_{name}_ms" for k, f in parts)


CODE = "code as (select doc_id, regexp_replace(text, '\\.\\n', E'.\\ndef f():\\n    ', 'g') as text from docs)"

ORACLE_SQL: dict[str, str] = {
    "decontaminate_ngrams": f"with {HITS} select doc_id, lang, source, n_chars from documents where doc_id not in (select doc_id from hits)",
    "contaminated_docs": f"with {HITS} select doc_id from hits",
    "ngram_index": f"with {INDEX} select ngram from idx",
    "benchmark_union": "select distinct text from (select text[1:length(text) // 3] || text[length(text) // 3 + 1:length(text) // 3 * 2] || text[length(text) // 3 * 2 + 1:] as text from benchmark union all select text from (select coalesce(text, '') as text from documents))",
    "text_candidates": f"with {FILES} select doc_id, path from files where not is_generated and length_bytes between 1 and 2097152 and list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) <= 2000 and length(regexp_replace(content, '[^A-Za-z0-9]', '', 'g')) / greatest(length(content), 1) >= 0.25",
    "char_length_band": "select doc_id, n_chars from documents where length(text) between 50 and 1000000",
    "reject_reason_funnel": f"with {STATS} select coalesce(case when core_py_files < 2 then 'few files' when core_py_ratio < 0.55 then 'low ratio' when bucket is null then 'size mismatch' when score < 60 then 'low score' end, 'admitted') as reason, count(*) as repos from scored group by 1",
    "admission_filter": f"with {STATS} select repo_name, bucket, round(score, 6) as score from admitted",
    "postcheck_repo": f"with {FILES} select repo_name, sum(length_bytes)::bigint as total_bytes, coalesce(sum(length_bytes) filter (path like '%.py'), 0)::bigint as py_bytes, coalesce(sum(length_bytes) filter (path like '%.py'), 0) >= 2048 and coalesce(sum(length_bytes) filter (path like '%.py'), 0) / sum(length_bytes) >= 0.55 as passed from files group by 1",
    "owner_counts": f"with {STATS} select owner, count(*) as repos from admitted group by 1",
    "shortlist_sort": f"with {STATS} select repo_name, bucket, row_number() over (partition by bucket order by score desc, repo_name) as rank from admitted",
    "buckets_parsed": "select bucket, lo, hi, quota, count(*) as documents from documents join (values (0, 1024, 4096, 1048576), (1, 4096, 32768, 2097152), (2, 32768, 1048576, 4194304)) t(bucket, lo, hi, quota) on n_chars >= lo and n_chars < hi group by all",
    "repo_stats": f"with {STATS} select repo_name, owner, has_src, total_bytes, core_bytes, core_py_bytes, core_py_files, eligible_files, round(core_py_ratio, 6) as core_py_ratio from stats",
    "repo_score": f"with {STATS} select repo_name, round(score, 6) as score, concat_ws(' ;', 'core_ratio=' || printf('%.2f', core_py_ratio), case when core_py_files >= 40 then 'core_py>=40' when core_py_files >= 25 then 'core_py>=25' end, case when has_src then 'src/lib' end) as reason from scored",
    "repo_bucket": f"with {STATS} select repo_name, total_bytes, bucket, lo, hi from scored left join (values (0, 1000, 10000), (1, 10000, 50000), (2, 50000, 2000000)) b(i, lo, hi) on bucket = i",
    "bucket_topk": f"with {STATS} select repo_name, bucket, rank from (select *, row_number() over (partition by bucket order by score desc, repo_name) as rank from scored where bucket is not null) where rank <= 3",
    "scan_early_stop": f"with {STATS}, numbered as (select *, row_number() over (order by repo_name) as ordinal from scored), kth as (select *, row_number() over (partition by bucket order by ordinal) as r from numbered where bucket is not null) select case when count(*) = 3 then max(ordinal) end as stop_ordinal from kth where r = 2",
    "sanitize_names": "select page_id, left(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+', ''), '[._-]+$', ''), ''), 'repo'), 180) as name from pages",
    "safe_paths": "select page_id, array_to_string(list_transform(string_split(regexp_replace(replace(replace(url, '/en', '/..'), chr(92), '/'), '^/+', ''), '/'), lambda x: case when x = '..' then '__UP__' else x end), '/') as path from pages",
    "token_counts": f"with {DOCS} select doc_id, {n_tokens('text')} as tokens from docs",
    "truncate_to_budget": f"""with {FILES}, sized as (select *, {n_tokens('repo_name')} + {n_tokens('path')} + 4 as heads, {n_tokens('content')} as n from files where length(content) between 50 and 1000000),
        kept as (select *, least(n, greatest(2040 - heads, 0)) as k from sized)
        select doc_id, k as content_length, k + heads as total_length, case when n <= k then content else array_to_string(regexp_extract_all(content, '\\s*(?:[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s])')[1:k], '') end as content from kept where k >= 128""",
    "corpus_metrics": f"""with {FILES}, sized as (select *, {n_tokens('repo_name')} + {n_tokens('path')} + 4 as heads, {n_tokens('content')} as n from files where length(content) between 50 and 1000000),
        kept as (select least(n, greatest(2040 - heads, 0)) as content_length, least(n, greatest(2040 - heads, 0)) + heads as total_length from sized where least(n, greatest(2040 - heads, 0)) >= 128)
        select count(*) as total_count, sum(content_length)::bigint as content_length, min(content_length) as min_content_length, max(content_length) as max_content_length, round(avg(content_length), 6) as average_content_length,
          sum(total_length)::bigint as total_length, min(total_length) as min_total_length, max(total_length) as max_total_length, round(avg(total_length), 6) as average_total_length from kept""",
    "filtered_metrics": f"""with {FILES}, {HITS}, sized as (select *, {n_tokens('repo_name')} + {n_tokens('path')} + 4 as heads, {n_tokens('content')} as n from files where doc_id not in (select doc_id from hits) and length(content) between 50 and 1000000),
        kept as (select least(n, greatest(2040 - heads, 0)) as content_length, least(n, greatest(2040 - heads, 0)) + heads as total_length from sized where least(n, greatest(2040 - heads, 0)) >= 128)
        select count(*) as total_count, sum(content_length)::bigint as content_length, min(content_length) as min_content_length, max(content_length) as max_content_length, round(avg(content_length), 6) as average_content_length,
          sum(total_length)::bigint as total_length, min(total_length) as min_total_length, max(total_length) as max_total_length, round(avg(total_length), 6) as average_total_length from kept""",
    "repo_sample_totals": f"""with {FILES}, sized as (select repo_name, {n_tokens('repo_name')} + {n_tokens('path')} + 4 as heads, {n_tokens('content')} as n from files where length(content) between 50 and 1000000)
        select coalesce(repo_name, 'overall') as repo, count(*) as samples from sized where least(n, greatest(2040 - heads, 0)) >= 128 group by rollup (repo_name)""",
    "token_band": f"with {DOCS}, s as (select doc_id, {n_tokens('text')} as tokens from docs) select doc_id, tokens, tokens < 2048 as short, tokens > 2048 and tokens < 4096 as long from s where tokens < 2048 or (tokens > 2048 and tokens < 4096)",
}

CONTEXT = (
    FILES
    + f""",
lined as (select *, case when content = '' then [] when right(content, 1) = chr(10) then string_split(left(content, length(content) - 1), chr(10)) else string_split(content, chr(10)) end as ls from files),
heads as (select repo_name, path, array_to_string(ls[1:25], chr(10)) || chr(10) as text from lined),
costed as (select *, {n_tokens('text')} as length, {n_tokens('path')} + 2 + {n_tokens('text')} as cost from heads),
pairs as (select a.repo_name, a.path, b.path as context_path, b.text as context_text, b.length as context_length, b.cost, row_number() over (partition by a.repo_name, a.path order by b.path) as rank
  from files a join costed b on a.repo_name = b.repo_name and a.path <> b.path and starts_with(b.path, split_part(a.path, '/', 1) || '/')),
ran as (select *, sum(cost) over (partition by repo_name, path order by context_path rows unbounded preceding)::bigint as running from pairs where rank <= 5),
ctx as (select repo_name, path, rank, context_path, context_text, context_length, running from ran where running <= 512)"""
)
ORACLE_SQL |= {
    "cross_file_context": f"with {CONTEXT} select * from ctx",
    "intra_cross_ratio": f"""with {CONTEXT}, joined as (select repo_name, path, coalesce(string_agg('<|file_sep|>' || context_path || chr(10) || context_text, '' order by rank), '') as cfc from files left join ctx using (repo_name, path) group by 1, 2),
        s as (select sum({n_tokens('f.content')})::bigint as intra_tokens, sum({n_tokens("'<|repo_name|>' || f.repo_name || chr(10) || cfc || '<|file_sep|>' || f.path || chr(10)")})::bigint as cross_tokens from files f join joined using (repo_name, path))
        select intra_tokens, cross_tokens, round(100.0 * intra_tokens / (intra_tokens + cross_tokens), 6) as intra_percent from s""",
    "fim_character": f"with {DOCS}, t as (select * from docs), {CUT} select t.doc_id, case when b is null then t.text else '{PRE}' || t.text[1:a] || '{SUF}' || t.text[b + 1:] || '{MID}' || t.text[a + 1:b] end as prompt from t left join c2 using (doc_id)",
    "fim_token": f"with {DOCS}, t as (select doc_id, {SPANS} as w, len({SPANS}) as n from docs), {CUT} select doc_id, array_to_string(w[1:a], '') as prefix, array_to_string(w[a + 1:b], '') as middle, array_to_string(w[b + 1:], '') as suffix from c2 union all select doc_id, null, null, null from t where n < 10",
    "mode_router": f"select doc_id, case when ({draw('doc_id', 3)}) / 2147483648.0 < 0.5 then 'sfim' when ({draw('doc_id', 3)}) / 2147483648.0 < 0.8 then 'fim' else 'l2r' end as mode from documents",
    "label_mask": f"with {DOCS}, t as (select doc_id, list_transform({tokens('text')}, lambda x: length(x) + 1000) as ids from docs), l as (select doc_id, ids, coalesce(list_position(ids, 1012), 0) as spot from t) select doc_id, array_to_string(list_transform(ids, lambda x, i: case when i <= spot then -100 else x end), ',') as labels from l",
    "pad_batch": f"""with {DOCS}, t as (select doc_id, list_transform({tokens('text')}, lambda x: length(x) + 1000) as ids, row_number() over (order by doc_id) - 1 as r from docs),
        b as (select *, r // 4 as batch_id, max(len(ids)) over (partition by r // 4) as m from t)
        select doc_id, batch_id, array_to_string(list_concat(ids, list_transform(range(0, m - len(ids)), lambda x: 0)), ',') as input_ids, array_to_string(list_concat(ids, list_transform(range(0, m - len(ids)), lambda x: -100)), ',') as labels, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(0, m - len(ids)), lambda x: 0)), ',') as attention_mask from b""",
    "prompt_fim": f"with {DOCS}, {THIRDS} select doc_id, '{PRE}' || prefix || middle || '{SUF}' || suffix || '{MID}' as prompt from p",
    "prompt_efim": f"with {DOCS}, {THIRDS} select doc_id, '{PRE}' || prefix || '{SUF}' || suffix || '{MID}' || middle as prompt from p",
    "rounds_efim": f"with {DOCS}, r as (select *, unnest(range(0, 5)) as round, n // 2 as h from docs) select doc_id, round, text[1:h // 7] as prefix, text[h // 7 + 1:floor(h / 7 * (round + 2))::bigint] as middle, text[h + 1:] as suffix from r",
    "rounds_k_parts": f"with {DOCS}, {THIRDS}, r as (select *, length(middle) as m, unnest(range(2, 7)) as i from p) select doc_id, i - 2 as round, middle[1:i * (m // 6) + least(i, m % 6)] as middle from r",
    "ground_truth_span": f"""with {DOCS}, t as (select *, {between('doc_id', 1, '16', '128')} as size, {between('doc_id', 2, '32', 'n - 160')} as b from docs where n >= 192), u as (select *, {between('doc_id', 3, '1', 'b - 1')} as c from t)
        select doc_id, text[1:c] as prefix, text[c + 1:b] as typed, text[b + 1:b + size] as groundtruth, text[b + size + 1:] as suffix from u""",
    "prompt_cut": f"with {DOCS}, t as (select *, {between('doc_id', 1, '1', 'n - 1')} as c from docs where n >= 2) select doc_id, text[1:c] as prefix, text[c + 1:] as typed from t",
    "mode_split_cross": f"with {DOCS}, {THIRDS} select mode, split, count(*) as prompts, sum(length(prefix) + length(middle))::bigint as chars from p cross join (values ('fim'), ('efim'), ('sfim')) m(mode) cross join (values ('efim'), ('function'), ('cceval')) s(split) group by 1, 2",
    "line_split": f"""with {DOCS}, l as (select doc_id, case when text = '' then [] when right(text, 1) = chr(10) then string_split(left(text, n - 1), chr(10)) else string_split(text, chr(10)) end as ls from docs)
        select doc_id, array_to_string(ls[1:1], chr(10)) || chr(10) as before, ls[2] as current, array_to_string(ls[3:], chr(10)) || chr(10) as after from l""",
    "exact_match": f"with {COMP} select a.role, count(*) as count, round(100 * avg((a.completion = b.completion)::int), 6) as em from comp a join comp b on a.task_id = b.task_id and b.completion_id = a.completion_id + 1 group by 1",
    "pass_at_k": f"""with {COMP}, s as (select task_id, count(*) as n, count(*) filter (passed) as c from comp group by 1)
        select task_id, n, c, round(case when c = 0 then 0 when n - c < 1 then 1 else 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 1.0 / i)) end, 6) as pass_at_1, round(case when c = 0 then 0 when n - c < 2 then 1 else 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 2.0 / i)) end, 6) as pass_at_2 from s""",
    "pass_at_k_mean": f"""with {COMP}, s as (select task_id, count(*) as n, count(*) filter (passed) as c from comp group by 1),
        p as (select n, case when c = 0 then 0 when n - c < 1 then 1 else 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 1.0 / i)) end as a, case when c = 0 then 0 when n - c < 2 then 1 else 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 2.0 / i)) end as b from s)
        select round(avg(a), 6) as pass_at_1, case when min(n) >= 2 then round(avg(b), 6) end as pass_at_2 from p""",
    "problem_dictionary": f"with {COMP} select task_id, completion_id, completion from comp qualify row_number() over (partition by task_id order by completion_id desc) = 1",
    "join_problems": f"with {COMP}, last as (select * from comp qualify row_number() over (partition by task_id order by completion_id desc) = 1) select c.task_id, c.completion_id, c.role, l.role as last_role, l.completion as last_text from comp c join last l on c.task_id = l.task_id",
    "unattempted": "select doc_id as task_id from documents where doc_id not in (select conv_id from conversations)",
    "attach_results": f"with {COMP} select task_id, completion_id, role, case when role = 'assistant' then passed end as passed, case when role = 'assistant' then case when passed then 'passed' else 'failed' end end as result from comp",
    "completion_ordinal": "select conv_id as task_id, turn * 10 + 3 as arrived, row_number() over (partition by conv_id order by turn) - 1 as completion_id from conversations",
    "replicate": "select item_id, text, completion_id from benchmark cross join range(0, 3) r(completion_id)",
    "assembled_results": f"with {REQ} select mode, trunc(avg(latency) * 100) / 100.0 as latency, trunc(100 * avg(success::int) * 100) / 100.0 as success, trunc(avg(prompt_len) filter (success) * 100) / 100.0 as asked, trunc(avg(output_len) filter (success) * 100) / 100.0 as answered from req group by 1 having count(*) filter (success) > 0",
    "junk_names": f"""with n as (select doc_id, concat(lower(regexp_extract(coalesce(text, ''), '^(\\w+)', 1)), '-', case doc_id % 3 when 0 then 'demo' when 1 then 'demonstrate' else 'x_tutorial.v2' end) as name from documents),
        t as (select doc_id, list_filter(regexp_split_to_array(name, '[^a-z0-9]+'), lambda x: x <> '') as w from n),
        u as (select doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) as w from t)
        select doc_id, len(list_filter(w, lambda x: x in ({", ".join(f"'{x}'" for x in JUNK_TOKENS)}))) > 0 as junk, array_to_string(w, ' ') as tokens from u""",
    "levenshtein_similarity": "with t as (select conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') as t from conversations) select a.conv_id, a.turn, round(case when greatest(length(a.t), length(b.t)) = 0 then 1 else 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) end, 6) as similarity from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1",
    "check_program": f"with {COMP} select task_id, completion_id, 'p' || completion || 's' || chr(10) || 'assert ' || role || chr(10) || 'check(f' || task_id || ')' as program from comp",
    "success_filter": f"with {REQ} select mode, count(*) as requests, count(*) filter (success) as completed, sum(case when success then output_len else 0 end)::bigint as total_output from req group by 1",
    "throughput": f"with {REQ} select count(*) as requests, count(*) filter (success) as completed, sum(prompt_len)::bigint as total_input, round(count(*) filter (success) / 100.0, 6) as request_throughput, round(sum(prompt_len) / 100.0, 6) as input_throughput, round(sum(case when success then output_len else 0 end) / 100.0, 6) as output_throughput from req",
    "latency_metrics": f"""with {REQ}, g as (select mode, unnest(itl) as gap from req where success),
        a as (select mode, {stat('ttft', 'ttft', 'success')}, {stat('(latency - ttft) / (output_len - 1)', 'tpot', 'success and output_len > 1')}, round(avg(latency) filter (success) * 1000, 6) as avg_latency_ms from req group by 1),
        b as (select mode, {stat('gap', 'itl', 'true')} from g group by 1)
        select a.*, coalesce(mean_itl_ms, 0) as mean_itl_ms, coalesce(median_itl_ms, 0) as median_itl_ms, coalesce(std_itl_ms, 0) as std_itl_ms, coalesce(p99_itl_ms, 0) as p99_itl_ms from a left join b using (mode)""",
    "itl_from_chunks": """with g as (select user_id, event_id, event_id - coalesce(lag(event_id) over (partition by user_id order by event_id), -1) as gap, row_number() over (partition by user_id order by event_id) as r from events)
        select user_id as request_id, max(case when r = 1 then gap end)::double as ttft, count(*) filter (r > 1) as gaps, coalesce(sum(gap) filter (r > 1), 0)::double as gap_sum, string_agg('t' || event_id % 10, '' order by event_id) as generated_text, (max(event_id) + 1)::double as latency from g group by 1""",
    "sse_chunks": """with l as (select user_id, event_id, event_type, min(case when event_type = 'error' then event_id end) over (partition by user_id) as done from events)
        select user_id as request_id, event_id as seq, event_type as text from l where event_type <> 'view' and (done is null or event_id < done)""",
    "cache_reuse": "select user_id, count(*) filter (event_type = 'view') as queries, count(*) filter (event_type = 'view' and event_id % 3 = 0) as hits, round(case when count(*) filter (event_type = 'view') > 0 then 100.0 * count(*) filter (event_type = 'view' and event_id % 3 = 0) / count(*) filter (event_type = 'view') else 0 end, 6) as reuse_percent from events group by 1",
    "metric_scrape": "select user_id, max_by(event_id, event_id) filter (event_type = 'view')::double as queries_total, max_by(event_id, event_id) filter (event_type = 'click')::double as hits_total from events group by 1",
    "language_rollup": "with r as (select lang, count(*) as count, 100 * avg((n_chars % 2 = 0)::int) as em from documents group by 1) select coalesce(lang, 'overall') as \"group\", sum(count)::bigint as count, round(sum(em * count) / sum(count), 6) as em from r group by rollup (lang)",
    "mode_pivot": f"with {REQ} select mode, trunc(avg(latency) * 100) / 100.0 as latency, trunc(100 * avg(success::int) * 100) / 100.0 as success from req group by 1",
    "sample_without_replacement": f"with {FILES} select doc_id, repo_name from (select *, row_number() over (partition by repo_name order by {draw('doc_id', 5)}, doc_id) as r from files) where r <= 3",
    "sample_with_replacement": f"""with {FILES}, numbered as (select doc_id, repo_name, row_number() over (partition by repo_name order by doc_id) - 1 as spot from files), sizes as (select repo_name, count(*) as size, min(doc_id) as seed from files group by 1),
        drawn as (select repo_name, d as draw, ({draw('(seed + 7919 * d)', 6)}) // 65536 % size as spot from sizes cross join range(0, 4) t(d) where size > 4)
        select doc_id, n.repo_name, draw from numbered n join drawn using (repo_name, spot) union all select doc_id, n.repo_name, spot as draw from numbered n join sizes using (repo_name) where size <= 4""",
}

#: Line breaks and white space in RE2; a line is taken with what ends it.
BREAKS = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
BLANKS = r"\t \x1F\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"


def lines_of(source: str, key: str, text: str) -> str:
    """``key, no, line, at`` of each line, from 1 and from 0."""
    listed = rf"regexp_extract_all({text}, '[^{BREAKS}]*(?:\r\n|[{BREAKS}])|[^{BREAKS}]+')"
    return f"select *, (sum(length(line)) over (partition by {key} order by no) - length(line))::bigint as at from (select {key}, unnest({listed}) as line, generate_subscripts({listed}, 1) as no from {source})"


CODE = r"code as (select doc_id, regexp_replace(coalesce(text, ''), '\.\n', E'.\ndef f():\n    ', 'g') as text from documents)"
FUNCTIONS = f"""{CODE},
lines as ({lines_of("code", "doc_id", "text")}),
seen as (select *, ltrim(line, ' ' || chr(9)) as bare, length(line) - length(ltrim(line, ' ' || chr(9))) as indent, regexp_full_match(line, '[{BREAKS}{BLANKS}]*') as blank from lines),
heads as (select * from seen where regexp_matches(bare, '^(async )?def ')),
ends as (select h.doc_id, h.no, min(l.at) as e from heads h join seen l on l.doc_id = h.doc_id and l.no > h.no and not l.blank and l.indent <= h.indent group by all),
tops as (select h.doc_id, h.no, max(l.no) as above from heads h join seen l on l.doc_id = h.doc_id and l.no < h.no and not (l.indent = h.indent and starts_with(l.bare, '@')) group by all),
spans as (select h.doc_id, h.no, t.at as a, coalesce(e.e, length(c.text)) as e, length(c.text) as n
  from heads h join code c using (doc_id) left join ends e using (doc_id, no) left join tops p using (doc_id, no) join lines t on t.doc_id = h.doc_id and t.no = coalesce(p.above, 0) + 1),
nearest as (select doc_id, arg_min(a, k) as a, arg_min(e, k) as e from (select *, (case when a > 0 and e < n then 0 else 1 end, abs(a + e - n), no) as k from spans) group by doc_id),
cut as (select c.doc_id, text, coalesce(a, length(text) // 2) as a, coalesce(e, length(text)) as e from code c left join nearest using (doc_id)),
parts as (select doc_id, text[1:a] as prefix, text[a + 1:e] as middle, text[e + 1:] as suffix from cut)"""


def marked(marks: list[str]) -> str:
    return f"'^[{BLANKS}]*(?:{'|'.join(marks)})'"


def sfim(source: str, p: str, s: str, tail: str) -> str:
    """Parts of a prompt whose function begins at the last marked line of ``p`` and ends before the first of ``s``."""
    return f"""flat as (select *, replace({p}, chr(13) || chr(10), chr(10)) as p, replace({s}, chr(13) || chr(10), chr(10)) as s from {source}),
begins as (select doc_id, max(l.at) as b from ({lines_of("flat", "doc_id", "p")}) l where regexp_matches(line, {marked(START_MARKS)}) group by doc_id),
stops as (select doc_id, min(l.at) as e from ({lines_of("flat", "doc_id", "s")}) l where regexp_matches(line, {marked(END_MARKS)}) group by doc_id),
placed as (select f.*, coalesce(b, 0) as b, coalesce(e, length(s)) as e from flat f left join begins using (doc_id) left join stops using (doc_id)),
sfim as (select *, '{PRE}' || p[1:b] || '{SUF}' || s[e + 1:] || '{PRE}' || p[b + 1:] || '{SUF}' || s[1:e] || '{MID}' || {tail} as sfim from placed)"""


FAR = FILES + ", far as (select doc_id, repo_name, case when doc_id % 3 = 0 then replace(path, '/f', '_more/f') else path end as path, content from files)"
ORACLE_SQL |= {
    "function_split": f"with {FUNCTIONS} select * from parts",
    "rounds_function": f"with {FUNCTIONS}, r as (select *, length(middle) as m, unnest(range(2, 7)) as i from parts) select doc_id, i - 2 as round, prefix, middle[1:i * (m // 6) + least(i, m % 6)] as middle, suffix from r",
    "prompt_sfim": f"with {CODE}, thirds as (select doc_id, text[1:length(text) // 3 * 2] as head, text[length(text) // 3 * 2 + 1:] as tail from code), {sfim('thirds', 'head', 'tail', chr(39) * 2)} select doc_id, sfim as prompt from sfim",
    "training_prompts": f"""with {FILES}, t as (select doc_id, '<|file_sep|>' || path || chr(10) || content as text, length('<|file_sep|>' || path || chr(10) || content) as n from files), {CUT},
        long as (select doc_id, text[1:a] as head, text[a + 1:b] as middle, text[b + 1:] as tail from c2), {sfim('long', 'head', 'tail', "replace(middle, chr(13) || chr(10), chr(10))")},
        moded as (select doc_id, text, ({draw('doc_id', 3)}) / 2147483648.0 as u from t)
        select doc_id, case when u < 0.5 then 'sfim' when u < 0.8 then 'fim' else 'l2r' end as mode,
          case when head is null or u >= 0.8 then text when u >= 0.5 then '{PRE}' || head || '{SUF}' || tail || '{MID}' || middle else sfim end || '<|endoftext|>' as prompt
        from moded left join sfim using (doc_id)""",
    "cross_file_context_literal": f"with {CONTEXT.replace('from files)', 'from far)').replace(FILES, FAR).replace('from files a', 'from far a')} select * from ctx",
}
ORACLE_SQL["cross_file_context_literal"] = ORACLE_SQL["cross_file_context_literal"].replace("starts_with(b.path, split_part(a.path, '/', 1) || '/')", "starts_with(b.path, split_part(a.path, '/', 1))")
