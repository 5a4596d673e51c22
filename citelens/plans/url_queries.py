"""Queries of the url functions, over candidates.url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.functions import url
from citelens.plans.registry import query
from citelens.plans.tables import table

_RX = "'^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$'"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


_URL, _DOMAIN = _strip("url"), _strip("domain")


def _part(n: int) -> str:
    return f"regexp_extract({_URL}, {_RX}, {n})"


_PATH = f"coalesce(nullif(regexp_replace({_part(3)}, '/+$', ''), ''), '/')"
_BLANK = f"coalesce({_URL}, '') = ''"


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").select("row_id", "url", "title", "domain")


def _one(name: str, sql: str, make) -> None:
    @query(name, f"SELECT row_id, {sql} AS key FROM candidates")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _urls(spark, folder).select("row_id", make(F.col("url")).alias("key"))


_one(
    "url_key_collector",
    f"CASE WHEN {_BLANK} THEN '' ELSE lower({_part(1)}) || '://' || lower({_part(2)}) || {_PATH} END",
    url.collector_key,
)


def repair_sql(column: str) -> str:
    """SQL of ``repair_key`` of a column."""
    key = (
        f"CASE WHEN {_BLANK} THEN '' ELSE regexp_replace(lower({_part(2)}), '^www\\.', '') || {_PATH} || "
        f"CASE WHEN {_part(4)} <> '' THEN '?' || {_part(4)} ELSE '' END END"
    )
    return key.replace(_URL, _strip(column))


_one("url_key_repair", repair_sql("url"), url.repair_key)
_BARE = f"regexp_replace(regexp_replace({_URL}, '^(?i:https?)://', ''), '#.*$', '')"
_REST = f"CASE WHEN contains({_BARE}, '/') THEN regexp_replace({_BARE}, '^[^/]*', '') ELSE '/' END"
_one(
    "url_key_validation",
    f"CASE WHEN {_BLANK} THEN '' ELSE regexp_replace(lower(split_part({_BARE}, '/', 1)), '^www\\.', '') || "
    f"coalesce(nullif(regexp_replace(split_part({_REST}, '?', 1), '/+$', ''), ''), '/') || "
    f"CASE WHEN contains({_REST}, '?') THEN regexp_replace({_REST}, '^[^?]*', '') ELSE '' END END",
    url.validation_key,
)
_one(
    "url_key_passage",
    f"regexp_replace(regexp_replace(regexp_replace(lower({_URL}), '^https?://', ''), '^www\\.', ''), '/+$', '')",
    url.passage_key,
)
_one("url_domain_strict", "nullif(regexp_extract(url, 'https?://([^/]+)/', 1), '')", url.domain_strict)
_one("url_domain_loose", "nullif(regexp_extract(url, 'https?://([^/]+)/?', 1), '')", url.domain_loose)
_one(
    "url_clean",
    "coalesce("
    + _strip(
        f"CASE WHEN regexp_matches({_URL}, '^\\[[^\\]]*\\]\\([^)]*\\)') THEN "
        f"regexp_extract({_URL}, '^\\[[^\\]]*\\]\\(([^)]*)\\)', 1) ELSE {_URL} END"
    )
    + ", '')",
    url.clean_url,
)
_one(
    "video_id_pattern",
    "coalesce(nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(url, 'youtu\\.be/([A-Za-z0-9_-]+)', 1), ''))",
    url.video_id_pattern,
)
_one("video_id_watch", "nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]+)', 1), '')", url.video_id_watch)
_one(
    "video_id_counted",
    "CASE WHEN contains(lower(url), 'youtu') THEN coalesce(nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{6,})', 1), ''), "
    "nullif(regexp_extract(url, '/(?:shorts|embed|v)/([A-Za-z0-9_-]{6,})', 1), ''), nullif(regexp_extract(url, 'youtu\\.be/([A-Za-z0-9_-]{6,})', 1), '')) END",
    url.video_id_counted,
)
_one("url_offset_seconds", "TRY_CAST(nullif(regexp_extract(url, '[?&]t=(\\d+)', 1), '') AS BIGINT)", url.offset_seconds)


@query(
    "domain_clean",
    "SELECT row_id, coalesce(regexp_replace(lower("
    + _strip(
        f"CASE WHEN regexp_matches({_DOMAIN}, '^\\[[^\\]]*\\]\\([^)]*\\)') THEN "
        f"regexp_extract({_DOMAIN}, '^\\[([^\\]]*)\\]', 1) ELSE {_DOMAIN} END"
    )
    + "), '^www\\.', ''), '') AS domain FROM candidates",
)
def domain_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).select("row_id", url.clean_domain(F.col("domain")).alias("domain"))


_TEXT = "lower(coalesce(url, '') || ' ' || coalesce(title, ''))"


def _contains(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({_TEXT}, '{w}')" for w in words) + ")"


@query(
    "url_flags",
    "SELECT row_id, CAST(coalesce(starts_with(url, 'https'), false) AS INTEGER) AS is_https, "
    + f"CAST(coalesce({' OR '.join(f'''contains(lower({_part(2)}), '{h}')''' for h in url.FORUM_HOSTS)}, false) AS INTEGER) AS is_forum, "
    + f"CAST(coalesce({' OR '.join(f'''contains(lower({_part(2)}), '{h}')''' for h in url.VIDEO_HOSTS)}, false) AS INTEGER) AS is_video, "
    + f"CASE WHEN {_contains(url.TRANSACTIONAL)} THEN 'transactional' WHEN {_contains(url.COMMERCIAL)} THEN 'commercial' ELSE 'informational' END "
    "AS guessed_type FROM candidates",
)
def url_flags(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, folder).select(
        "row_id",
        url.is_https(u).alias("is_https"),
        url.is_forum(u).alias("is_forum"),
        url.is_video_host(u).alias("is_video"),
        url.content_type(u, F.col("title")).alias("guessed_type"),
    )


@query(
    "video_summary",
    "WITH v AS (SELECT query_id, nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]+)', 1), '') AS vid, "
    "TRY_CAST(nullif(regexp_extract(url, '[?&]t=(\\d+)', 1), '') AS BIGINT) AS t FROM candidates) SELECT vid AS video_id, count(*) AS citations, "
    "count(DISTINCT query_id) AS queries, count(DISTINCT t) AS offsets FROM v WHERE vid IS NOT NULL GROUP BY vid",
)
def video_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of each video, and its distinct time offsets."""
    u = F.col("url")
    v = table(spark, folder, "candidates").select(
        "query_id", url.video_id_watch(u).alias("video_id"), url.offset_seconds(u).alias("t")
    )
    return v.where("video_id is not null").groupBy("video_id").agg(
        F.count("*").alias("citations"), F.countDistinct("query_id").alias("queries"), F.countDistinct("t").alias("offsets")
    )


_JOINED = f"""WITH k AS (SELECT *, CASE WHEN {_BLANK} THEN '' ELSE regexp_replace(lower({_part(2)}), '^www\\.', '') || {_PATH} ||
 CASE WHEN {_part(4)} <> '' THEN '?' || {_part(4)} ELSE '' END END AS url_key FROM candidates),
 l AS (SELECT query_id, CASE WHEN {_BLANK} THEN '' ELSE regexp_replace(lower({_part(2)}), '^www\\.', '') || {_PATH} ||
 CASE WHEN {_part(4)} <> '' THEN '?' || {_part(4)} ELSE '' END END AS url_key, label, row_id AS lid FROM label_validation)
 SELECT k.row_id, k.cited, l.label AS checked FROM k LEFT JOIN l ON k.query_id = l.query_id AND k.url_key = l.url_key
 QUALIFY row_number() OVER (PARTITION BY k.row_id ORDER BY l.lid NULLS FIRST) = 1"""


@query("rebuild_left_join_keep_first", _JOINED)
def rebuild_left_join_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first checked label of each candidate, by query and repair key.

    The keep-first is taken on the label side before the join, so that the join can't fan out.
    """
    from citelens.operators.relational import keep_first

    labels = table(spark, folder, "label_validation").where("query_id is not null").select(
        "query_id", url.repair_key(F.col("url")).alias("url_key"), F.col("label").alias("checked"), "row_id"
    )
    first = keep_first(labels, ["query_id", "url_key"], [F.col("row_id")]).drop("row_id")
    keyed = table(spark, folder, "candidates").select("row_id", "query_id", "cited", url.repair_key(F.col("url")).alias("url_key"))
    return keyed.join(first, ["query_id", "url_key"], "left").select("row_id", "cited", "checked")


@query(
    "rebuild_diff_report",
    "SELECT count(*) AS rows, count(checked) AS matched, count_if(cited = 0 AND checked = 1) AS zero_to_one, "
    f"count_if(cited = 1 AND checked = 0) AS one_to_zero FROM ({_JOINED})",
)
def rebuild_diff_report(spark: SparkSession, folder: str) -> DataFrame:
    """How the checked labels differ from the stored ones."""
    joined = rebuild_left_join_keep_first(spark, folder)
    return joined.agg(
        F.count("*").alias("rows"),
        F.count("checked").alias("matched"),
        F.count_if((F.col("cited") == 0) & (F.col("checked") == 1)).alias("zero_to_one"),
        F.count_if((F.col("cited") == 1) & (F.col("checked") == 0)).alias("one_to_zero"),
    )
