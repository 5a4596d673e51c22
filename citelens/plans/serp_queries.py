"""Queries of search responses and of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.functions import html, serp, url
from citelens.plans.registry import query
from citelens.plans.tables import table
from citelens.plans.url_queries import repair_sql
from citelens.schemas import SENTINEL_RANK, SERP_FEATURES

_R = (
    "WITH r AS (SELECT serp_id, query_id, json_extract(b, '$.tasks[0].result[0]') AS r FROM (SELECT serp_id, query_id, CASE WHEN json_valid(body) THEN body::JSON END AS b FROM serp_sample) "
    "WHERE json_type(json_extract(b, '$.tasks[0].result[0]')) = 'OBJECT'), i AS (SELECT serp_id, query_id, unnest(CAST(json_extract(r, '$.items[*]') AS JSON[])) AS x FROM r), "
    "ii AS (SELECT serp_id, query_id, x, x->>'$.type' AS type FROM i WHERE json_type(x) = 'OBJECT')"
)


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return serp.results(table(spark, folder, "serp_sample").select("serp_id", "query_id", "body"), "body")


@query(
    "serp_flags",
    _R + ", f AS (SELECT serp_id, list(type) AS t FROM ii GROUP BY serp_id) SELECT r.serp_id, "
    + ", ".join(f"CAST(coalesce(list_contains(t, '{n}'), false) AS INTEGER) AS has_{n}" for n in SERP_FEATURES)
    + " FROM r LEFT JOIN f ON r.serp_id = f.serp_id",
)
def serp_flags(spark: SparkSession, folder: str) -> DataFrame:
    r = _results(spark, folder)
    return r.select("serp_id", *[c.alias(n) for n, c in serp.feature_flags(F.col("result")).items()])


_REF_LISTS = (
    ", ov AS (SELECT serp_id, row_number() OVER () AS n, x FROM ii WHERE type = 'ai_overview'), "
    "oy AS (SELECT serp_id, n, unnest(CAST(json_extract(x, '$.items[*]') AS JSON[])) AS y FROM ov), "
    "rr AS (SELECT serp_id, unnest(CAST(json_extract(x, '$.references[*]') AS JSON[])) AS z FROM ov UNION ALL "
    "SELECT serp_id, unnest(CAST(json_extract(y, '$.references[*]') AS JSON[])) FROM oy), "
    "ref AS (SELECT serp_id, z FROM rr WHERE json_type(z) = 'OBJECT')"
)


@query(
    "serp_query_facts",
    _R + _REF_LISTS + ", f AS (SELECT serp_id, list(type) AS t, count(*) FILTER (type = 'organic') AS o, count(*) FILTER (type = 'ai_overview') AS a, "
    "count(*) FILTER (type = 'ai_overview' AND lower(x->>'$.asynchronous_ai_overview') = 'true') AS s FROM ii GROUP BY serp_id), "
    "c AS (SELECT serp_id, count(*) AS n FROM ref GROUP BY serp_id) SELECT r.serp_id, r.query_id, CAST(coalesce(o, 0) AS INTEGER) AS num_organic_results, "
    "CAST(coalesce(a, 0) > 0 AS INTEGER) AS ai_overview_present, CAST(coalesce(n, 0) AS INTEGER) AS ai_overview_num_references, "
    "CAST(coalesce(s, 0) > 0 AS INTEGER) AS ai_overview_is_async, "
    + ", ".join(f"CAST(coalesce(list_contains(t, '{n}'), false) AS INTEGER) AS has_{n}" for n in SERP_FEATURES)
    + " FROM r LEFT JOIN f ON r.serp_id = f.serp_id LEFT JOIN c ON r.serp_id = c.serp_id",
)
def serp_query_facts(spark: SparkSession, folder: str) -> DataFrame:
    return serp.query_facts(_results(spark, folder))


@query(
    "serp_rejected",
    "WITH b AS (SELECT serp_id, body, coalesce(json_valid(body), false) AS v FROM serp_sample), p AS (SELECT serp_id, body, v, CASE WHEN v THEN body::JSON END AS j FROM b) "
    "SELECT serp_id, CASE WHEN body IS NULL THEN 'no body' WHEN NOT v THEN 'not JSON' ELSE 'no result' END AS reason FROM p "
    "WHERE NOT v OR coalesce(json_type(json_extract(j, '$.tasks[0].result[0]')), '') <> 'OBJECT'",
)
def serp_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The responses that the other queries leave out, and why."""
    return serp.rejected(table(spark, folder, "serp_sample"), "serp_id", "body")


@query(
    "paa_questions",
    _R + ", q AS (SELECT serp_id, unnest(CAST(json_extract(x, '$.items[*]') AS JSON[])) AS y FROM ii WHERE type = 'people_also_ask') "
    "SELECT serp_id, y->>'$.title' AS question FROM q WHERE trim(coalesce(y->>'$.title', '')) <> ''",
)
def paa_questions(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("serp_id", F.explode(serp.questions(F.col("result"))).alias("question"))


@query(
    "serp_organic",
    _R + " SELECT serp_id, x->>'$.url' AS url, TRY_CAST(x->>'$.rank_group' AS INTEGER) AS organic_rank FROM ii WHERE type = 'organic'",
)
def serp_organic(spark: SparkSession, folder: str) -> DataFrame:
    x = _results(spark, folder).select("serp_id", F.explode(serp.items(F.col("result"), "organic")).alias("x"))
    return x.select("serp_id", F.col("x.url").alias("url"), F.col("x.rank_group").try_cast("int").alias("organic_rank"))


_REFS = (
    _R + ", o AS (SELECT serp_id, x FROM ii WHERE type = 'ai_overview'), e AS (SELECT serp_id, unnest(CAST(json_extract(x, '$.items[*]') AS JSON[])) AS y FROM o), "
    "f AS (SELECT serp_id, unnest(CAST(json_extract(x, '$.references[*]') AS JSON[])) AS z FROM o UNION ALL SELECT serp_id, unnest(CAST(json_extract(y, '$.references[*]') AS JSON[])) FROM e) "
)


@query("aio_reference_counts", _REFS + "SELECT serp_id, count(*) AS n FROM f WHERE json_type(z) = 'OBJECT' GROUP BY serp_id")
def aio_reference_counts(spark: SparkSession, folder: str) -> DataFrame:
    """References of all overviews; copies count."""
    n = F.size(serp.references(F.col("result"))).cast("bigint")
    return _results(spark, folder).select("serp_id", n.alias("n")).where("n > 0")


def _link(text: str, part: int) -> str:
    """The label (1) or target (2) of a markdown link around a text, else the text."""
    own = f"regexp_replace({text}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    link = r"'^\[([^\]]*)\]\(([^)]*)\)'"
    inner = f"CASE WHEN regexp_matches({own}, {link}) THEN regexp_extract({own}, {link}, {part}) ELSE {own} END"
    return f"coalesce(regexp_replace({inner}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')"


@query(
    "aio_citations",
    _R + _REF_LISTS + f" SELECT serp_id, {_link("(z->>'$.url')", 2)} AS cited_url, regexp_replace(lower({_link("(z->>'$.domain')", 1)}), '^www\\.', '') AS cited_domain, "
    "coalesce(z->>'$.title', '') AS cited_title, coalesce(z->>'$.text', '') AS cited_snippet FROM ref",
)
def aio_citations(spark: SparkSession, folder: str) -> DataFrame:
    return serp.citations(_results(spark, folder), "serp_id")


@query(
    "aio_text",
    _R + _REF_LISTS + ", l AS (SELECT serp_id, list_filter(CAST(json_extract(r, '$.items[*]') AS JSON[]), lambda x: x->>'$.type' = 'ai_overview') AS o FROM r), "
    "t AS (SELECT serp_id, trim(array_to_string(list_filter(flatten(list_transform(o, lambda x: list_concat([nullif(x->>'$.markdown', '')], "
    "flatten(list_transform(CAST(json_extract(x, '$.items[*]') AS JSON[]), lambda y: [nullif(y->>'$.text', ''), nullif(y->>'$.title', '')]))))), lambda v: v IS NOT NULL), chr(10))) AS t FROM l), "
    "c AS (SELECT serp_id, count(*) AS n FROM ref GROUP BY serp_id) "
    "SELECT t.serp_id, CAST(length(t) AS INTEGER) AS aio_char_len, t AS aio_text, CAST(coalesce(n, 0) AS INTEGER) AS aio_num_references "
    "FROM t LEFT JOIN c ON t.serp_id = c.serp_id WHERE t <> ''",
)
def aio_text(spark: SparkSession, folder: str) -> DataFrame:
    """The overviews' whole texts, with their lengths."""
    text = serp.overview_text(F.col("result"))
    rows = _results(spark, folder).select("serp_id", text.alias("aio_text"), F.size(serp.references(F.col("result"))).alias("aio_num_references"))
    return rows.where("aio_text <> ''").select("serp_id", F.length("aio_text").alias("aio_char_len"), "aio_text", "aio_num_references")


@query(
    "serp_candidates",
    _R + ", own AS (SELECT serp_id, n, l[n] AS x FROM (SELECT serp_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT serp_id, CAST(json_extract(r, '$.items[*]') AS JSON[]) AS l FROM r))), "
    "org AS (SELECT serp_id, n, x->>'$.url' AS url, TRY_CAST(x->>'$.rank_group' AS INTEGER) AS organic_rank, x->>'$.title' AS title, x->>'$.description' AS snippet "
    "FROM own WHERE x->>'$.type' = 'organic' AND x->>'$.url' IS NOT NULL), "
    "lists AS (SELECT serp_id, n, list_concat(CAST(json_extract(x, '$.references[*]') AS JSON[]), flatten(list_transform(CAST(json_extract(x, '$.items[*]') AS JSON[]), "
    "lambda y: CAST(json_extract(y, '$.references[*]') AS JSON[])))) AS l FROM own WHERE x->>'$.type' = 'ai_overview'), "
    "cit AS (SELECT serp_id, 1000000 * n + m AS n, l[m] AS z FROM (SELECT serp_id, n, l, unnest(range(1, len(l) + 1)) AS m FROM lists)), "
    f"refs AS (SELECT serp_id, n, {_link("(z->>'$.url')", 2)} AS url, z->>'$.title' AS title, z->>'$.text' AS snippet FROM cit WHERE json_type(z) = 'OBJECT'), "
    f"ok AS (SELECT *, {repair_sql('url')} AS k FROM org), ck AS (SELECT *, {repair_sql('url')} AS k FROM refs WHERE url <> ''), "
    "every AS (SELECT serp_id, n, url, organic_rank, title, snippet, k, coalesce(organic_rank, 100) AS ord FROM ok UNION ALL "
    f"SELECT serp_id, n, url, {SENTINEL_RANK}, title, snippet, k, {SENTINEL_RANK} FROM ck WHERE NOT EXISTS (FROM ok WHERE ok.serp_id = ck.serp_id AND ok.k = ck.k)) "
    "SELECT serp_id, url, organic_rank, title, snippet, CAST(EXISTS (FROM ck WHERE ck.serp_id = every.serp_id AND ck.k = every.k) AS INTEGER) AS cited FROM every "
    "QUALIFY row_number() OVER (PARTITION BY serp_id, k ORDER BY ord, n) = 1",
)
def serp_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return serp.candidates(_results(spark, folder), "serp_id", url.repair_key)


@query(
    "question_frequency",
    _R + ", q AS (SELECT serp_id, unnest(CAST(json_extract(x, '$.items[*]') AS JSON[])) AS y FROM ii WHERE type = 'people_also_ask') "
    "SELECT lower(trim(y->>'$.title', ' ')) AS question, count(*) AS n FROM q WHERE trim(coalesce(y->>'$.title', '')) <> '' GROUP BY 1",
)
def question_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return paa_questions(spark, folder).groupBy(F.lower(F.trim("question")).alias("question")).agg(F.count("*").alias("n"))


_PAGES = "SELECT page_id, html FROM page_content WHERE ok AND length(html) > 0"


@query(
    "html_counts",
    "SELECT page_id, CAST(least(50, len(regexp_extract_all(h, '<(?:ul|ol|table)[ >]'))) AS INTEGER) AS num_lists_tables, "
    f"CAST(contains(h, '<details') AS INTEGER) AS has_details FROM (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM ({_PAGES}))",
)
def html_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lists and tables, and whether the page has a details element, counted on the JVM."""
    pages = table(spark, folder, "page_content").where("ok and length(html) > 0")
    return pages.select(
        "page_id",
        F.least(html.tag_count(F.col("html"), "ul", "ol", "table"), F.lit(50)).alias("num_lists_tables"),
        (html.tag_count(F.col("html"), "details") > 0).cast("int").alias("has_details"),
    )


@query("onpage_features")
def onpage_features(spark: SparkSession, folder: str) -> DataFrame:
    return html.onpage_features(table(spark, folder, "page_content"), "2026-07-17", "page_id").drop("page_text")


@query("html_positions")
def html_positions(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_content").where("ok and length(html) > 0")
    return html.positions(pages, "page_id", "query_id", "candidate_idx")
