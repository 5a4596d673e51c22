"""Queries over candidates and query_meta: populations, aggregates, windows, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelens.functions import stats, url
from citelens.operators import ranges, relational
from citelens.plans.registry import query
from citelens.plans.tables import C, candidates, table
from citelens.schemas import CONTENT_FEATURES, RANK_FEATURES, SENTINEL_RANK, SERP_FEATURES, stable_columns

SQL_DOMAIN = "replace(nullif(regexp_extract(url, 'https?://([^/]+)/', 1), ''), 'www.', '')"


def ranked() -> Column:
    """Whether the row has a true rank."""
    return F.col("organic_rank") != SENTINEL_RANK


def domain() -> Column:
    return url.without_www(url.domain_strict(F.col("url")))


def segment() -> Column:
    return (
        F.when(F.coalesce("has_local_pack", F.lit(0)) == 1, "local")
        .when(F.coalesce("has_featured_snippet", F.lit(0)) == 1, "snippet")
        .otherwise("informational")
    )


def _r(x, n: int = 6):
    return F.round(x, n)


@query(
    "citation_rate_by_type",
    "SELECT content_type, count(*) AS candidates, CAST(sum(cited) AS BIGINT) AS citations, "
    "round(avg(cited) * 100, 1) AS citation_rate_pct FROM candidates GROUP BY content_type",
)
def citation_rate_by_type(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "candidates").createOrReplaceTempView("citelens_candidates")
    return spark.sql(
        "SELECT content_type, count(*) AS candidates, sum(cited) AS citations, "
        "round(avg(cited) * 100, 1) AS citation_rate_pct FROM citelens_candidates "
        "GROUP BY content_type ORDER BY citation_rate_pct DESC"
    )


_BUCKET = (
    "SELECT CASE WHEN organic_rank <= 3 THEN '1 top 3' WHEN organic_rank <= 10 THEN '2 rank 4-10' ELSE '3 rank 11+' END "
    "AS rank_bucket, count(*) AS candidates, CAST(sum(cited) AS BIGINT) AS citations, "
    "round(avg(cited) * 100, 1) AS citation_rate_pct FROM {} GROUP BY rank_bucket"
)


@query("citation_rate_by_bucket", _BUCKET.format("candidates"))
def citation_rate_by_bucket(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "candidates").createOrReplaceTempView("citelens_candidates")
    return spark.sql(_BUCKET.format("citelens_candidates") + " ORDER BY rank_bucket")


def engineer(df: DataFrame) -> DataFrame:
    """rank_reciprocal and both structure scores: weighted, and additive with nulls as 0."""
    lists = F.least(F.greatest("num_lists_tables", F.lit(0)), F.lit(5)) / 5
    flag = {x: F.coalesce(x, F.lit(0)) for x in ("has_schema", "has_faq", "num_lists_tables")}
    return df.withColumns(
        {
            "rank_reciprocal": 1 / F.greatest("organic_rank", F.lit(1)),
            "structure_score": F.round(0.4 * F.col("has_schema") + 0.4 * F.col("has_faq") + 0.2 * lists, 3),
            "structure_points": flag["has_schema"] + flag["has_faq"] + (flag["num_lists_tables"] > 3).cast("int"),
        }
    )


_ENGINEERED = """SELECT row_id, 1.0::double / greatest(organic_rank, 1) AS rank_reciprocal,
 round(0.4::double * has_schema + 0.4::double * has_faq + 0.2::double * (least(greatest(num_lists_tables, 0), CASE WHEN num_lists_tables IS NULL THEN NULL ELSE 5 END) / 5::double), 3) AS structure_score,
 coalesce(has_schema, 0) + coalesce(has_faq, 0) + CASE WHEN coalesce(num_lists_tables, 0) > 3 THEN 1 ELSE 0 END AS structure_points
 FROM candidates"""


@query("engineered_features", _ENGINEERED)
def engineered_features(spark: SparkSession, folder: str) -> DataFrame:
    """least and greatest skip nulls, so the weighted score is NULL only through its other parts."""
    df = engineer(candidates(spark, folder))
    score = F.when(F.col("num_lists_tables").isNotNull(), F.col("structure_score"))
    return df.select("row_id", "rank_reciprocal", score.alias("structure_score"), "structure_points")


@query(
    "ranked_only_population",
    "SELECT query_id, count(*) AS n, CAST(sum(cited) AS BIGINT) AS cited, count(DISTINCT url) AS urls FROM candidates "
    "WHERE organic_rank <> 101 GROUP BY query_id",
)
def ranked_only_population(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder).where(ranked())
    return rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum("cited").alias("cited"), F.countDistinct("url").alias("urls")
    )


def variant(df: DataFrame, name: str) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, numeric features, categorical features). A: ranked rows, with ranks. B: all rows, without ranks."""
    specs = {"A": (True, RANK_FEATURES + CONTENT_FEATURES), "B": (False, list(CONTENT_FEATURES))}
    if name not in specs:
        raise ValueError(f"unknown variant {name!r}, not in {sorted(specs)}")
    ranked_only, numeric = specs[name]
    return (df.where(ranked()) if ranked_only else df), numeric, ["content_type"]


def _variant_query(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows, numeric, categorical = variant(engineer(candidates(spark, folder)), name)
    return rows.select("row_id", "cited", *[c for c in numeric if c != "structure_score"], *categorical)


_CONTENT_SQL = ", ".join(c for c in CONTENT_FEATURES if c != "structure_score") + ", content_type"


@query(
    "variant_a",
    f"{C} SELECT row_id, cited, organic_rank, 1.0::double / greatest(organic_rank, 1) AS rank_reciprocal, {_CONTENT_SQL} "
    "FROM c WHERE organic_rank <> 101",
)
def variant_a(spark: SparkSession, folder: str) -> DataFrame:
    return _variant_query(spark, folder, "A")


@query("variant_b", f"{C} SELECT row_id, cited, {_CONTENT_SQL} FROM c")
def variant_b(spark: SparkSession, folder: str) -> DataFrame:
    return _variant_query(spark, folder, "B")


@query(
    "conditional_population",
    "SELECT row_id, query_id, cited FROM (SELECT *, max(cited) OVER (PARTITION BY query_id) AS any_cited FROM candidates) "
    "WHERE any_cited > 0",
)
def conditional_population(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the queries with a positive: a semi-join on an aggregate, so that no query is gathered in one task."""
    df = candidates(spark, folder)
    having = df.where("cited > 0").select("query_id").distinct()
    return df.join(having, "query_id", "left_semi").select("row_id", "query_id", "cited")


@query("crawl_ok_population", "SELECT row_id FROM candidates WHERE crawl_ok IS DISTINCT FROM 0")
def crawl_ok_population(spark: SparkSession, folder: str) -> DataFrame:
    return candidates(spark, folder).where(~F.col("crawl_ok").eqNullSafe(0)).select("row_id")


@query(
    "domain_rate_transform",
    f"SELECT row_id, round(avg(cited) OVER (PARTITION BY {SQL_DOMAIN}), 3) AS domain_citation_rate FROM candidates",
)
def domain_rate_transform(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of a row's domain: an aggregate joined back, so that a hot domain is reduced before it moves."""
    df = candidates(spark, folder).select("row_id", "cited", domain().alias("d"))
    rates = df.groupBy("d").agg(F.round(F.avg("cited"), 3).alias("domain_citation_rate"))
    same = df["d"].eqNullSafe(rates["d"])
    return df.join(rates, same).select("row_id", "domain_citation_rate")


_IMPUTED = ["word_count", "num_lists_tables", "readability_score", "content_freshness_days"]


@query(
    "impute_global_median",
    f"{C}, m AS (SELECT "
    + ", ".join(f"median({x}) AS m_{x}" for x in _IMPUTED)
    + " FROM c) SELECT row_id, "
    + ", ".join(f"coalesce(CAST({x} AS DOUBLE), m_{x}, 0) AS {x}" for x in _IMPUTED)
    + ", coalesce(has_schema, 0) AS has_schema, coalesce(has_faq, 0) AS has_faq FROM c, m",
)
def impute_global_median(spark: SparkSession, folder: str) -> DataFrame:
    filled = relational.impute_median(candidates(spark, folder), _IMPUTED, ["has_schema", "has_faq"])
    return filled.select("row_id", *_IMPUTED, "has_schema", "has_faq")


_LEADERS = f"""SELECT d AS domain, n, k AS cited, round(k / n::double, 6) AS rate, round(k / n::double / base, 6) AS lift
 FROM (SELECT {SQL_DOMAIN} AS d, count(*) AS n, CAST(sum(cited) AS BIGINT) AS k FROM candidates
       WHERE organic_rank <> 101 GROUP BY d),
      (SELECT avg(cited) AS base FROM candidates WHERE organic_rank <> 101) WHERE d IS NOT NULL AND n >= 20"""


def _leaders(spark: SparkSession, folder: str, least: int) -> DataFrame:
    rows = candidates(spark, folder).where(ranked()).select("cited", domain().alias("domain"))
    base = rows.agg(F.avg("cited").alias("base"))
    counts = rows.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), F.sum("cited").alias("cited"))
    return counts.where(F.col("n") >= least).crossJoin(F.broadcast(base))


@query("domain_leaderboard", _LEADERS)
def domain_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.col("cited") / F.col("n")
    out = _leaders(spark, folder, 20).select(
        "domain", "n", "cited", _r(rate).alias("rate"), _r(rate / F.col("base")).alias("lift")
    )
    return out.orderBy(F.desc("rate"), F.desc("n"), "domain")


@query(
    "domain_leaderboard_wilson",
    f"""SELECT domain, n, cited, round(greatest(0, (cited / n::double + 3.8416 / (2 * n) - 1.96 * sqrt((cited / n::double) * (1 - cited / n::double) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
 round(least(1, (cited / n::double + 3.8416 / (2 * n) + 1.96 * sqrt((cited / n::double) * (1 - cited / n::double) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS high
 FROM ({_LEADERS.replace("n >= 20", "n >= 30")})""",
)
def domain_leaderboard_wilson(spark: SparkSession, folder: str) -> DataFrame:
    low, high = stats.wilson(F.col("cited"), F.col("n"))
    return _leaders(spark, folder, 30).select("domain", "n", "cited", _r(low).alias("low"), _r(high).alias("high"))


_META = "(SELECT * FROM query_meta QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY num_candidates, query) = 1)"
_SEGMENT = (
    "CASE WHEN coalesce(has_local_pack, 0) = 1 THEN 'local' WHEN coalesce(has_featured_snippet, 0) = 1 THEN 'snippet' "
    "ELSE 'informational' END"
)


def query_meta(spark: SparkSession, folder: str) -> DataFrame:
    """One row of each query."""
    meta = table(spark, folder, "query_meta")
    return relational.keep_first(
        meta, ["query_id"], [F.col("num_candidates").asc_nulls_last(), F.col("query").asc_nulls_last()]
    )


@query(
    "intent_segment_summary",
    f"""SELECT segment, count(*) AS queries, round(avg(ai_overview_present), 6) AS aio_rate,
 round(avg(coalesce(rate, 0)), 6) AS citation_rate FROM (SELECT query_id, ai_overview_present, {_SEGMENT} AS segment FROM {_META}) m
 LEFT JOIN (SELECT query_id, avg(cited) AS rate FROM candidates GROUP BY query_id) r USING (query_id) GROUP BY segment""",
)
def intent_segment_summary(spark: SparkSession, folder: str) -> DataFrame:
    rates = candidates(spark, folder).groupBy("query_id").agg(F.avg("cited").alias("rate"))
    joined = query_meta(spark, folder).select("query_id", "ai_overview_present", segment().alias("segment")).join(rates, "query_id", "left")
    return joined.groupBy("segment").agg(
        F.count("*").alias("queries"),
        _r(F.avg("ai_overview_present")).alias("aio_rate"),
        _r(F.avg(F.coalesce("rate", F.lit(0.0)))).alias("citation_rate"),
    )


@query(
    "segment_examples",
    f"""SELECT segment, string_agg(query, ' | ' ORDER BY query) AS examples FROM
 (SELECT segment, query, row_number() OVER (PARTITION BY segment ORDER BY query) AS r FROM
   (SELECT DISTINCT {_SEGMENT} AS segment, query FROM {_META} WHERE query IS NOT NULL)) WHERE r <= 3 GROUP BY segment""",
)
def segment_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The first three queries of each segment: a top-k report, limited before anything is collected."""
    named = query_meta(spark, folder).where("query is not null").select(segment().alias("segment"), "query").distinct()
    first = relational.top_k(named, ["segment"], [F.col("query")], 3)
    return first.groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list("query")), " | ").alias("examples"))


_WORDS = (
    "CASE WHEN word_count > 0 AND word_count <= 500 THEN '(0, 500]' WHEN word_count > 500 AND word_count <= 1000 THEN '(500, 1000]' "
    "WHEN word_count > 1000 AND word_count <= 2000 THEN '(1000, 2000]' WHEN word_count > 2000 AND word_count <= 4000 THEN '(2000, 4000]' "
    "WHEN word_count > 4000 AND word_count <= 100000 THEN '(4000, 100000]' END"
)


@query(
    "wordcount_curve",
    f"""SELECT bucket, count(*) AS n_all, round(avg(cited), 6) AS rate_all, count_if(organic_rank <> 101) AS n_ranked,
 round(avg(CASE WHEN organic_rank <> 101 THEN cited END), 6) AS rate_ranked
 FROM (SELECT {_WORDS} AS bucket, cited, organic_rank FROM candidates) WHERE bucket IS NOT NULL GROUP BY bucket""",
)
def wordcount_curve(spark: SparkSession, folder: str) -> DataFrame:
    bucketed = candidates(spark, folder).select(F.expr(_WORDS).alias("bucket"), "cited", "organic_rank")
    return (
        bucketed.where("bucket is not null")
        .groupBy("bucket")
        .agg(
            F.count("*").alias("n_all"),
            _r(F.avg("cited")).alias("rate_all"),
            F.count_if(ranked()).alias("n_ranked"),
            _r(F.avg(F.when(ranked(), F.col("cited")))).alias("rate_ranked"),
        )
    )


_FLAGS = ["has_schema", "has_faq", "is_https", "is_forum", "is_video"]


@query(
    "artifact_audit_flags",
    "WITH b AS (SELECT avg(cited) AS base, avg(CASE WHEN organic_rank <> 101 THEN cited END) AS base_r FROM candidates), f AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, avg(CASE WHEN {f} = 1 THEN cited END) AS a, "
        f"avg(CASE WHEN {f} = 1 AND organic_rank <> 101 THEN cited END) AS r FROM candidates"
        for f in _FLAGS
    )
    + ") SELECT flag, round(a, 6) AS rate_all, round(a / base, 6) AS lift_all, round(r, 6) AS rate_restricted, "
    "round(r / base_r, 6) AS lift_restricted, CAST((abs(a / base - r / base_r) > 0.3 OR (a / base > 1) <> (r / base_r > 1)) "
    "AS INTEGER) AS distorted FROM f, b",
)
def artifact_audit_flags(spark: SparkSession, folder: str) -> DataFrame:
    audit = relational.flag_audit(candidates(spark, folder), _FLAGS, "cited", ranked())
    rounded = {c: _r(F.col(c)) for c in ("rate_all", "lift_all", "rate_restricted", "lift_restricted")}
    return audit.withColumns(rounded)


@query(
    "candidate_quota",
    "SELECT row_id, query_id, cited FROM (SELECT *, sum(1 - cited) OVER (PARTITION BY query_id ORDER BY organic_rank, row_id "
    "ROWS UNBOUNDED PRECEDING) AS taken FROM candidates) WHERE cited = 1 OR taken <= 5",
)
def candidate_quota(spark: SparkSession, folder: str) -> DataFrame:
    kept = relational.quota(
        candidates(spark, folder), ["query_id"], [F.col("organic_rank"), F.col("row_id")], F.col("cited") == 1, 5
    )
    return kept.select("row_id", "query_id", "cited")


@query(
    "topk_fixed",
    "SELECT row_id, query_id, position FROM (SELECT row_id, query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY "
    "organic_rank, row_id) AS INTEGER) AS position FROM candidates) WHERE position <= 3",
)
def topk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    top = relational.top_k(candidates(spark, folder), ["query_id"], [F.col("organic_rank"), F.col("row_id")], 3)
    return top.select("row_id", "query_id", "position")


@query(
    "candidate_positions",
    "SELECT row_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY organic_rank, url NULLS FIRST, row_id) - 1 AS INTEGER) AS idx "
    "FROM candidates",
)
def candidate_positions(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col("organic_rank"), F.col("url"), F.col("row_id")]
    return relational.position_in_group(candidates(spark, folder), ["query_id"], order, "idx").select("row_id", "idx")


@query(
    "keep_first_candidates",
    "SELECT row_id, query_id, url FROM candidates QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY organic_rank, "
    "row_id) = 1",
)
def keep_first_candidates(spark: SparkSession, folder: str) -> DataFrame:
    first = relational.keep_first(
        candidates(spark, folder), ["query_id", "url"], [F.col("organic_rank"), F.col("row_id")]
    )
    return first.select("row_id", "query_id", "url")


@query(
    "oof_target_encoding",
    f"""WITH x AS (SELECT {SQL_DOMAIN} AS d, CAST((dense_rank() OVER (ORDER BY query_id) - 1) % 5 AS INTEGER) AS fold, cited FROM candidates),
 p AS (SELECT avg(cited) AS prior FROM x), k AS (SELECT d, fold, sum(cited) AS s, count(*) AS n FROM x WHERE d IS NOT NULL GROUP BY d, fold),
 t AS (SELECT d, sum(s) AS t, sum(n) AS a FROM k GROUP BY d), f AS (SELECT DISTINCT fold FROM x)
 SELECT t.d AS domain, f.fold, round((t.t - coalesce(k.s, 0) + prior * 10) / (t.a - coalesce(k.n, 0) + 10), 6) AS encoded
 FROM t CROSS JOIN f CROSS JOIN p LEFT JOIN k ON k.d = t.d AND k.fold = f.fold""",
)
def oof_target_encoding(spark: SparkSession, folder: str) -> DataFrame:
    from citelens.operators.validation import rank_folds

    df = candidates(spark, folder).select("query_id", "cited", domain().alias("domain"))
    folded = df.join(rank_folds(df, "query_id", 5), "query_id")
    prior_rows = folded.withColumn("domain", F.col("domain"))
    encoded = relational.out_of_group_mean(prior_rows, "domain", "fold", "cited")
    return encoded.where("domain is not null").select("domain", "fold", _r(F.col("encoded")).alias("encoded"))


@query(
    "mark_join_cited",
    "SELECT row_id, CAST(query_id IN (SELECT query_id FROM query_meta WHERE ai_overview_present = 1 AND query_id IS NOT NULL) "
    "AS INTEGER) AS has_overview FROM candidates",
)
def mark_join_cited(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "query_meta").where("ai_overview_present = 1")
    return relational.mark_join(candidates(spark, folder), keys, ["query_id"], "has_overview").select("row_id", "has_overview")


@query(
    "anti_join_unranked",
    "SELECT DISTINCT query_id, url FROM candidates a WHERE organic_rank = 101 AND url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM candidates b "
    "WHERE b.organic_rank <> 101 AND a.query_id = b.query_id AND a.url = b.url)",
)
def anti_join_unranked(spark: SparkSession, folder: str) -> DataFrame:
    df = candidates(spark, folder)
    key = ["query_id", "url"]
    unranked = df.where(~ranked() & F.col("url").isNotNull()).select(key).distinct()
    return unranked.join(df.where(ranked()).select(key), key, "left_anti")


@query(
    "semi_join_covered",
    "SELECT query_id, num_candidates FROM query_meta WHERE query_id IN (SELECT query_id FROM page_content WHERE ok)",
)
def semi_join_covered(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_content").where("ok").select("query_id")
    return table(spark, folder, "query_meta").join(pages, "query_id", "left_semi").select("query_id", "num_candidates")


@query(
    "union_candidates",
    "SELECT query_id, url, organic_rank, 1 AS ranked FROM candidates WHERE organic_rank <> 101 UNION ALL "
    "SELECT DISTINCT query_id, url, 101 AS organic_rank, 0 AS ranked FROM candidates a WHERE organic_rank = 101 AND url IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM candidates b WHERE b.organic_rank <> 101 AND a.query_id = b.query_id AND a.url = b.url)",
)
def union_candidates(spark: SparkSession, folder: str) -> DataFrame:
    own = candidates(spark, folder).where(ranked()).select("query_id", "url", "organic_rank", F.lit(1).alias("ranked"))
    rest = anti_join_unranked(spark, folder)
    return own.unionByName(rest.select("query_id", "url", F.lit(SENTINEL_RANK).alias("organic_rank"), F.lit(0).alias("ranked")))


@query(
    "repeated_key_mass",
    "SELECT count(*) AS urls, count_if(q > 1) AS repeated, CAST(sum(CASE WHEN q > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_repeated, "
    "round(sum(CASE WHEN q > 1 THEN n ELSE 0 END) / sum(n)::double, 6) AS share FROM (SELECT url, count(*) AS n, "
    "count(DISTINCT query_id) AS q FROM candidates WHERE url IS NOT NULL GROUP BY url)",
)
def repeated_key_mass(spark: SparkSession, folder: str) -> DataFrame:
    each = candidates(spark, folder).where("url is not null").groupBy("url").agg(
        F.count("*").alias("n"), F.countDistinct("query_id").alias("q")
    )
    mass = F.sum(F.when(F.col("q") > 1, F.col("n")).otherwise(0))
    return each.agg(
        F.count("*").alias("urls"),
        F.count_if(F.col("q") > 1).alias("repeated"),
        mass.alias("rows_in_repeated"),
        _r(mass / F.sum("n")).alias("share"),
    )


@query(
    "concentration_topk",
    f"""WITH k AS (SELECT {SQL_DOMAIN} AS d, count(*) AS n FROM candidates WHERE cited = 1 GROUP BY d HAVING d IS NOT NULL),
 r AS (SELECT n, row_number() OVER (ORDER BY n DESC, d) AS r FROM k)
 SELECT count(*) AS keys, round(sum(CASE WHEN r <= 1 THEN n END) / sum(n)::double, 6) AS top_1_share,
 round(sum(CASE WHEN r <= 5 THEN n END) / sum(n)::double, 6) AS top_5_share,
 round(sum(CASE WHEN r <= 10 THEN n END) / sum(n)::double, 6) AS top_10_share FROM r""",
)
def concentration_topk(spark: SparkSession, folder: str) -> DataFrame:
    cited = candidates(spark, folder).where("cited = 1").select(domain().alias("d")).where("d is not null")
    out = relational.concentration(cited, "d", (1, 5, 10))
    return out.withColumns({c: _r(F.col(c)) for c in out.columns if c != "keys"})


@query(
    "constant_value_share",
    "SELECT count(*) AS groups, round(avg(CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END), 6) AS constant_share FROM (SELECT url, count(*) AS n, "
    "count(DISTINCT organic_rank) AS d FROM candidates WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1)",
)
def constant_value_share(spark: SparkSession, folder: str) -> DataFrame:
    each = candidates(spark, folder).where("url is not null").groupBy("url").agg(
        F.count("*").alias("n"), F.countDistinct("organic_rank").alias("d")
    )
    return each.where("n > 1").agg(
        F.count("*").alias("groups"), _r(F.avg((F.col("d") == 1).cast("double"))).alias("constant_share")
    )


_TYPES = ("informational", "commercial", "transactional")


@query(
    "pivot_rank_group",
    "SELECT organic_rank, "
    + ", ".join(f"round(avg(CASE WHEN content_type = '{t}' THEN cited END), 6) AS {t}" for t in _TYPES)
    + " FROM candidates WHERE organic_rank <= 10 GROUP BY organic_rank",
)
def pivot_rank_group(spark: SparkSession, folder: str) -> DataFrame:
    top = candidates(spark, folder).where("organic_rank <= 10")
    wide = top.groupBy("organic_rank").pivot("content_type", list(_TYPES)).agg(F.avg("cited"))
    return wide.withColumns({t: _r(F.col(t)) for t in _TYPES})


@query(
    "query_group_summary",
    "SELECT query_id, count(*) AS n, round(max(passage_match_score), 6) AS best, round(avg(passage_match_score), 6) AS mean, "
    "arg_max(url, struct_pack(s := passage_match_score, r := -row_id)) FILTER (WHERE passage_match_score IS NOT NULL) AS best_url "
    "FROM candidates GROUP BY query_id",
)
def query_group_summary(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("passage_match_score")
    best = F.max_by("url", F.when(score.isNotNull(), F.struct(score, -F.col("row_id"))))
    return candidates(spark, folder).groupBy("query_id").agg(
        F.count("*").alias("n"), _r(F.max(score)).alias("best"), _r(F.avg(score)).alias("mean"), best.alias("best_url")
    )


@query(
    "feature_quantiles",
    f"{C} SELECT round(quantile_cont(word_count, 0.1), 6) AS q10, round(median(word_count), 6) AS q50, "
    "round(quantile_cont(word_count, 0.9), 6) AS q90, (list_sort(list(word_count) FILTER (WHERE word_count IS NOT NULL)))"
    "[CAST(floor(0.9 * count(word_count)) AS BIGINT) + 1] AS by_index, count(DISTINCT url) AS urls, round(stddev_samp(word_count), 6) AS sd, "
    "round(stddev_pop(word_count), 6) AS sd_pop FROM c",
)
def feature_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Interpolated quantiles, and one by position in the sorted values; sorted in ranges of counted values."""
    df = candidates(spark, folder)
    counts = df.where("word_count is not null").groupBy("word_count").agg(F.count("*").alias("n"))
    placed = ranges.running(counts, "word_count", ["n"])
    by_index = placed.where(F.col("cum_n") > F.floor(0.9 * F.col("all_n"))).agg(F.min("word_count").alias("by_index"))
    q = ranges.quantiles(df, "word_count", [0.1, 0.5, 0.9])
    interpolated = q.select(*(_r(F.get("q", i)).alias(name) for i, name in enumerate(("q10", "q50", "q90"))))
    one = df.agg(
        F.countDistinct("url").alias("urls"),
        _r(F.stddev_samp("word_count")).alias("sd"),
        _r(F.stddev_pop("word_count")).alias("sd_pop"),
    )
    return one.crossJoin(F.broadcast(by_index)).crossJoin(F.broadcast(interpolated))


@query(
    "evidence_filter",
    "SELECT query_id, count_if(organic_rank <> 101) AS n_ranked, CAST(sum(cited) AS BIGINT) AS n_cited FROM candidates GROUP BY query_id "
    "HAVING sum(cited) >= 3 AND count_if(organic_rank <> 101) >= 2",
)
def evidence_filter(spark: SparkSession, folder: str) -> DataFrame:
    each = candidates(spark, folder).groupBy("query_id").agg(F.count_if(ranked()).alias("n_ranked"), F.sum("cited").alias("n_cited"))
    return each.where("n_cited >= 3 and n_ranked >= 2")


@query(
    "queries_with_citation",
    "SELECT CAST(sum(m) AS BIGINT) AS queries_cited, count(*) AS queries, round(avg(m), 6) AS share FROM (SELECT query_id, max(cited) AS m FROM candidates "
    "GROUP BY query_id)",
)
def queries_with_citation(spark: SparkSession, folder: str) -> DataFrame:
    each = candidates(spark, folder).groupBy("query_id").agg(F.max("cited").alias("m"))
    return each.agg(F.sum("m").alias("queries_cited"), F.count("*").alias("queries"), _r(F.avg("m")).alias("share"))


@query(
    "feature_frequency",
    "SELECT feature, count(*) AS n, CAST(sum(v) AS BIGINT) AS present FROM (UNPIVOT (SELECT "
    + ", ".join(f"has_{f}" for f in SERP_FEATURES)
    + " FROM query_meta) ON COLUMNS(*) INTO NAME feature VALUE v) GROUP BY feature",
)
def feature_frequency(spark: SparkSession, folder: str) -> DataFrame:
    names = [f"has_{f}" for f in SERP_FEATURES]
    long = table(spark, folder, "query_meta").unpivot([], names, "feature", "v").where("v is not null")
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.sum("v").alias("present"))


@query(
    "class_descriptives",
    f"{C}, x AS (UNPIVOT (SELECT cited, CAST(word_count AS DOUBLE) AS word_count, CAST(num_lists_tables AS DOUBLE) AS num_lists_tables, "
    "readability_score, query_url_similarity FROM c) ON word_count, num_lists_tables, readability_score, query_url_similarity INTO NAME feature VALUE v) "
    "SELECT feature, "
    + ", ".join(
        f"round({f}(v) FILTER (WHERE cited = {k}), 6) AS {n}_{k}"
        for k in (0, 1)
        for f, n in (("avg", "mean"), ("median", "median"), ("stddev_samp", "std"))
    )
    + " FROM x GROUP BY feature",
)
def class_descriptives(spark: SparkSession, folder: str) -> DataFrame:
    names = ["word_count", "num_lists_tables", "readability_score", "query_url_similarity"]
    df = candidates(spark, folder).select("cited", *(F.col(x).cast("double") for x in names))
    long = df.unpivot(["cited"], names, "feature", "v")
    wide = long.groupBy("feature").pivot("cited", [0, 1]).agg(_r(F.avg("v")).alias("mean"), _r(F.stddev_samp("v")).alias("std"))
    middle = ranges.quantiles(long, "v", [0.5], ["feature", "cited"])
    medians = middle.groupBy("feature").agg(*(F.max(F.when(F.col("cited") == k, _r(F.get("q", 0)))).alias(f"{k}_median") for k in (0, 1)))
    return wide.join(medians, "feature", "left").select("feature", *(F.col(f"{k}_{n}").alias(f"{n}_{k}") for k in (0, 1) for n in ("mean", "median", "std")))


_PEARSON = ["word_count", "num_lists_tables", "query_url_similarity", "passage_match_score", "cited"]


@query(
    "pearson_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM candidates" for a in _PEARSON for b in _PEARSON
    ),
)
def pearson_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs in one pass; each over the rows that have both values."""
    df = candidates(spark, folder)
    pairs = [(a, b) for i, a in enumerate(_PEARSON) for b in _PEARSON[i:]]

    def corr(a: str, b: str):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return _r(F.corr(F.when(both, F.col(a)), F.when(both, F.col(b)))).alias(f"{a}__{b}")

    wide = df.agg(*(corr(a, b) for a, b in pairs))
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}" if (a, b) in pairs else f"{b}__{a}").alias("r"))
        for a in _PEARSON
        for b in _PEARSON
    ]
    return wide.select(F.inline(F.array(*cells)))


@query(
    "stable_prefix",
    "SELECT row_id, query_id, url, organic_rank, cited FROM candidates",
)
def stable_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Contractual columns first, the others after them."""
    df = table(spark, folder, "candidates").select("row_id", "cited", "organic_rank", "url", "query_id")
    return stable_columns(df, ["query_id", "url", "organic_rank", "cited"])


@query("prevalence", "SELECT count(*) AS n, CAST(sum(cited) AS BIGINT) AS positives, round(avg(cited), 6) AS prevalence FROM candidates")
def prevalence(spark: SparkSession, folder: str) -> DataFrame:
    return candidates(spark, folder).agg(
        F.count("*").alias("n"), F.sum("cited").alias("positives"), _r(F.avg("cited")).alias("prevalence")
    )
