"""Queries for the string functions (group I of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import text as fx
from cuelake.plans.catalog import query
from cuelake.session import table


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


@query("fn_clean_text", r"""
SELECT page_id, array_to_string(list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\\[Nn]', chr(10), 'g'), '\\h|&nbsp;', ' ', 'g'), '\{[^}]*\}', '', 'g'), '<[^>]+>', '', 'g'), '\r\n?', chr(10), 'g'), chr(10)),
    lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g')), lambda x: x <> ''), chr(10)) AS clean FROM pages""")
def fn_clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", fx.clean_plain_text(F.col("html")).alias("clean"))


@query("fn_append_unique", """
SELECT conv_id, turn, CASE WHEN trim(role) = '' OR list_contains(string_split(text, chr(10)), trim(role)) THEN text WHEN text = '' THEN trim(role) ELSE text || chr(10) || trim(role) END AS text
FROM conversations""")
def fn_append_unique(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", fx.append_unique_line(F.col("text"), F.col("role")).alias("text"))


@query("fn_merge_field", """
SELECT conv_id, string_agg(role, ' / ' ORDER BY first) AS speakers
FROM (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE trim(role) <> '' GROUP BY ALL) GROUP BY conv_id""")
def fn_merge_field(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", fx.merge_distinct(F.col("t.role")).alias("speakers"))


@query("fn_newlines", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, ' ', chr(13)), '^' || chr(65279), ''), '\r\n?', chr(10), 'g')) AS digest FROM documents""")
def fn_newlines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(fx.normalize_newlines(F.replace("text", F.lit(" "), F.lit("\r")))).alias("digest"))


@query("fn_terms", r"""
SELECT item_id, array_to_string(CASE WHEN len(t) > 0 THEN t WHEN q = '' THEN [] ELSE [q] END, '|') AS terms
FROM (SELECT item_id, lower(trim(text)) AS q, regexp_extract_all(lower(trim(text)), '[\p{L}\p{N}_]+') AS t FROM benchmark)""")
def fn_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(fx.search_terms(F.col("text")), "|").alias("terms"))


@query("fn_kw_sanitize", """
SELECT p_partkey, trim(regexp_replace(p_type || '>' || p_name || ' *, ', '[,，<>|*]', '', 'g')) AS name FROM part""")
def fn_kw_sanitize(spark, sf):
    return _part(spark, sf).select("p_partkey", fx.sanitize_keyword(F.concat("p_type", F.lit(">"), "p_name", F.lit(" *, "))).alias("name"))


# paths, a repeated one, and every eleventh row with mixed separators, every seventh with an empty name
_KEYWORDS = """concat(p_type, CASE WHEN p_partkey % 2 = 0 THEN '>' ELSE '<' END, p_name, CASE WHEN p_partkey % 11 = 0 THEN '|x' ELSE '' END, ', ',
    p_brand, '，', p_brand, CASE WHEN p_partkey % 7 = 0 THEN ',a<<b' ELSE '' END)"""


@query("fn_kw_parse", f"""
WITH v AS (SELECT p_partkey, trim(u.v) AS v, u.i FROM (SELECT p_partkey, unnest(list_zip(regexp_split_to_array({_KEYWORDS}, '[,，]'), range(100))) AS z FROM part) q,
     LATERAL (SELECT z[1] AS v, z[2] AS i) u WHERE z[1] IS NOT NULL),
p AS (SELECT p_partkey, i, CASE WHEN contains(v, '<') THEN list_reverse(n) ELSE n END AS n,
    CASE WHEN contains(v, '>')::INT + contains(v, '<')::INT + contains(v, '|')::INT > 1 THEN 'mixed' WHEN list_contains(n, '') THEN 'empty' END AS e
    FROM (SELECT *, list_transform(regexp_split_to_array(v, '[<>|]'), lambda x: trim(regexp_replace(x, '[,，<>|*]', '', 'g'))) AS n FROM v WHERE v <> '')),
a AS (SELECT p_partkey, arg_min(e, i) FILTER (e IS NOT NULL) AS error FROM p GROUP BY ALL),
d AS (SELECT p_partkey, array_to_string(n, '>') AS path, min(i) AS i FROM p GROUP BY ALL)
SELECT a.p_partkey, CASE WHEN error IS NULL THEN string_agg(path, '; ' ORDER BY i) ELSE '' END AS paths, coalesce(error, '') AS error
FROM a JOIN d USING (p_partkey) GROUP BY a.p_partkey, error""")
def fn_kw_parse(spark, sf):
    parsed = fx.parse_keywords(F.expr(_KEYWORDS))
    return _part(spark, sf).select("p_partkey", parsed.alias("p")).select(
        "p_partkey", F.array_join(F.transform("p.paths", lambda n: F.array_join(n, ">")), "; ").alias("paths"), F.coalesce("p.error", F.lit("")).alias("error")
    )


@query("fn_kw_lenient", f"""
WITH v AS (SELECT p_partkey, trim(z[1]) AS v, z[2] AS i FROM (SELECT p_partkey, unnest(list_zip(regexp_split_to_array({_KEYWORDS}, '[,，]'), range(100))) AS z FROM part) WHERE z[1] IS NOT NULL),
s AS (SELECT *, CASE WHEN contains(v, '>') THEN '>' WHEN contains(v, '<') THEN '<' WHEN contains(v, '|') THEN '|' ELSE '' END AS sep FROM v WHERE v <> ''),
o AS (SELECT p_partkey, i, CASE WHEN sep = '' THEN trim(regexp_replace(v, '[,，<>|*]', '', 'g'))
    ELSE list_reduce(list_filter(list_transform(string_split(v, sep), lambda x: trim(regexp_replace(x, '[,，<>|*]', '', 'g'))), lambda x: x <> ''), lambda a, b: a || sep || b) END AS t FROM s)
SELECT p_partkey, string_agg(t, ', ' ORDER BY i) AS text FROM o WHERE t <> '' GROUP BY p_partkey""")
def fn_kw_lenient(spark, sf):
    return _part(spark, sf).select("p_partkey", fx.lenient_keywords(F.expr(_KEYWORDS)).alias("text"))


@query("fn_kw_format", """
SELECT p_partkey, p_name || '<' || p_brand || '<' || p_type AS path, array_to_string(list_sort([p_name || '<' || p_type, p_brand]), ', ') AS paths FROM part""")
def fn_kw_format(spark, sf):
    paths = F.array(F.array("p_type", "p_name"), F.array("p_brand"))
    return _part(spark, sf).select("p_partkey", fx.format_keyword_path(F.array("p_type", "p_brand", "p_name")).alias("path"), fx.format_keyword_paths(paths).alias("paths"))


@query("fn_kw_expand", """
SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type, p_name || '<' || p_type, p_brand || '<' || p_name || '<' || p_type, p_brand])), ', ') AS text FROM part""")
def fn_kw_expand(spark, sf):
    paths = F.array(F.array("p_type", "p_name", "p_brand"), F.array("p_type", "p_name"), F.array("p_brand"))
    return _part(spark, sf).select("p_partkey", fx.expand_keyword_paths(paths).alias("text"))


_DIRTY = "concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ':a/b?' ELSE '' END, p_type, CASE WHEN p_partkey % 4 = 0 THEN '. .' ELSE '' END)"


@query("fn_safe_name", rf"""
SELECT p_partkey, regexp_replace(trim(regexp_replace(n, '[<>:"/\\|?*\x00-\x1f\x7f]', '_', 'g')), '[. ]+$', '') AS shown,
    regexp_replace(trim(regexp_replace(n, '[<>:"/\\|?*\x00-\x1f\x7f]', '_', 'g')), '^\.+|\.+$', '', 'g') AS written
FROM (SELECT p_partkey, {_DIRTY} AS n FROM part)""")
def fn_safe_name(spark, sf):
    return _part(spark, sf).select("p_partkey", fx.file_name_component(F.expr(_DIRTY)).alias("shown"), fx.safe_component(F.expr(_DIRTY)).alias("written"))


@query("fn_clamp_name", """
WITH n AS (SELECT p_partkey, repeat(p_name, 1 + CAST(p_partkey % 20 AS INT)) AS base, CASE p_partkey % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.averylongextension' ELSE '' END AS ext, '-' || CAST(p_partkey AS VARCHAR) AS tail FROM part)
SELECT p_partkey, CASE WHEN length(base || ext) <= 120 THEN base || ext WHEN ext = '.mp4' THEN left(base, 116) || ext ELSE left(base || ext, 120) END AS file_name,
    CASE WHEN length(base || tail) <= 60 THEN base || tail ELSE left(base, least(length(base), 60 - length(tail))) || tail END AS base_name FROM n""")
def fn_clamp_name(spark, sf):
    base = F.expr("repeat(p_name, 1 + CAST(p_partkey % 20 AS INT))")
    ext = F.expr("CASE p_partkey % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.averylongextension' ELSE '' END")
    tail = F.concat(F.lit("-"), F.col("p_partkey").cast("string"))
    return _part(spark, sf).select("p_partkey", fx.clamp_file_name(F.concat(base, ext)).alias("file_name"), fx.clamp_base_name(F.concat(base, tail), 60).alias("base_name"))


@query("fn_rename_rule", """
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS label, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS custom, p_type AS filename FROM part)
SELECT p_partkey, coalesce(nullif(concat_ws('-', nullif(trim(custom), ''), nullif(trim(label), '')), ''), nullif(trim(label), ''), 'export') AS custom_label,
    concat_ws('-', nullif(trim(custom), ''), nullif(trim(filename), '')) AS custom_filename FROM s""")
def fn_rename_rule(spark, sf):
    segments = {"label": F.expr("CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END"), "custom": F.expr("CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END"), "filename": F.col("p_type")}
    return _part(spark, sf).select("p_partkey", fx.rename_base("custom_label", segments).alias("custom_label"), fx.rename_base("custom_filename", segments).alias("custom_filename"))


@query("fn_paths", """
SELECT p_partkey, p_name || '.MP4' AS base, '/m/' || p_type AS dir, 'mp4' AS ext, '/m/' || p_type || '/' || p_brand AS joined, p_brand AS output FROM part""")
def fn_paths(spark, sf):
    path = F.concat(F.lit("/m/"), "p_type", F.lit("/"), "p_name", F.lit(".MP4"))
    return _part(spark, sf).select(
        "p_partkey", fx.base_name(path).alias("base"), fx.dir_name(path).alias("dir"), fx.extension(path).alias("ext"), fx.join_path(fx.dir_name(path), F.col("p_brand")).alias("joined"),
        fx.effective_output_name(F.concat(F.lit(". "), "p_brand")).alias("output"),
    )


@query("fn_project_name", r"""
SELECT p_partkey, CASE WHEN n = '' THEN 'untitled' ELSE n END AS name FROM (
    SELECT p_partkey, regexp_replace(left(regexp_replace(regexp_replace(trim(x), '(?:[.]lcp|[.]LCP)$', ''), '[<>:"/\\|?*\x00-\x1f\x7f]', '_', 'g'), 80), '^[ .]+|[ .]+$', '', 'g') AS n
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '...' ELSE ' ' || p_name || ':' || p_type || '?.lcp ' END AS x FROM part))""")
def fn_project_name(spark, sf):
    return _part(spark, sf).select("p_partkey", fx.project_name(F.expr("CASE WHEN p_partkey % 9 = 0 THEN '...' ELSE ' ' || p_name || ':' || p_type || '?.lcp ' END")).alias("name"))


@query("fn_log_safe", "SELECT conv_id, turn, regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS line FROM conversations")
def fn_log_safe(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", fx.log_safe(F.col("text")).alias("line"))


@query("fn_stem", """
SELECT p_partkey, p_name || ' copy' || CASE WHEN p_partkey % 120 < 9 THEN '0' ELSE '' END || (p_partkey % 120 + 1) AS copied, regexp_replace(p_name || '.mov', '\\.[^.]*$', '') || '_export' AS stem FROM part""")
def fn_stem(spark, sf):
    stem = F.concat(F.regexp_replace(F.concat("p_name", F.lit(".mov")), r"\.[^.]*$", ""), F.lit("_export"))
    return _part(spark, sf).select("p_partkey", fx.copy_suffix(F.col("p_name"), F.col("p_partkey") % 120).alias("copied"), stem.alias("stem"))


@query("fn_human_units", """
WITH s AS (SELECT event_id, CAST(power(2, event_id % 44) AS BIGINT) + event_id % 1000 - 1 AS n, 8000 + (event_id % 40) * 100 AS hz, 20 + (event_id % 90) / 8.0 AS fps FROM events),
v AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS k FROM s),
x AS (SELECT *, n / power(1024.0, k) AS v FROM v)
SELECT event_id, CASE WHEN n <= 0 THEN '-' ELSE (CASE WHEN k = 0 OR v >= 10 THEN CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', floor(v * 10 + 0.5) / 10) END) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] END AS size,
    CASE WHEN hz % 1000 = 0 THEN CAST(hz // 1000 AS VARCHAR) ELSE printf('%.1f', hz / 1000.0) END || ' kHz' AS rate,
    CASE WHEN floor(fps * 100 + 0.5) / 100 = floor(floor(fps * 100 + 0.5) / 100) THEN CAST(CAST(floor(fps * 100 + 0.5) / 100 AS BIGINT) AS VARCHAR) ELSE printf('%.2f', CAST(floor(fps * 100 + 0.5) / 100 AS DOUBLE)) END AS fps FROM x""")
def fn_human_units(spark, sf):
    n = F.expr("CAST(pow(2, event_id % 44) AS BIGINT) + event_id % 1000 - 1")
    return table(spark, sf, "events").select("event_id", fx.human_size(n).alias("size"), fx.kilohertz(F.expr("8000 + (event_id % 40) * 100")).alias("rate"), fx.frame_rate_label(F.expr("20 + (event_id % 90) / 8D")).alias("fps"))


@query("fn_token_member", r"SELECT doc_id, list_contains(regexp_split_to_array(regexp_replace(text, '^ +| +$', '', 'g'), '\s+'), 'the') AS listed FROM documents")
def fn_token_member(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.has_token(F.col("text"), F.lit("the")).alias("listed"))


@query("fn_tag_value", """
SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END), ''), CAST(json_extract_string(props, '$.k') AS VARCHAR)) AS tag FROM events""")
def fn_tag_value(spark, sf):
    tags = F.expr("map('title', CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END, 'k', get_json_object(props, '$.k'))")
    return table(spark, sf, "events").select("event_id", fx.tag_value(tags, "name", "title", "k").alias("tag"))


@query("src_batch_dedup", """
SELECT p_partkey, path FROM (SELECT p_partkey, replace(p_type, ' ', '\\') || '\\' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS path,
    row_number() OVER (PARTITION BY lower(replace(replace(p_type, ' ', '\\') || '\\' || p_name, '\\', '/')) ORDER BY p_partkey) AS k FROM part) WHERE k = 1""")
def src_batch_dedup(spark, sf):
    from cuelake.operators.sets import first_by_key

    rows = _part(spark, sf).select("p_partkey", F.concat(F.translate("p_type", " ", "\\"), F.lit("\\"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("path"))
    return first_by_key(rows, fx.fold_path(F.col("path")), F.col("p_partkey"))
