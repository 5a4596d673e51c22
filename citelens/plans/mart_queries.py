"""Tidy tables for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.operators import inference, ranges, relational, validation
from citelens.plans.candidate_queries import _META, _SEGMENT, SQL_DOMAIN, domain, query_meta, ranked, segment
from citelens.plans.registry import query
from citelens.plans.serp_queries import _R, paa_questions
from citelens.plans.tables import candidates, table
from citelens.sources.readers import synthetic_candidates


@query(
    "mart_queries",
    f"""SELECT m.query_id, m.query, {_SEGMENT} AS segment, CASE ai_overview_present WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS has_overview,
 coalesce(n, 0) AS candidates, coalesce(k, 0) AS citations, round(coalesce(k / nullif(n, 0)::double, 0), 6) AS rate FROM {_META} m
 LEFT JOIN (SELECT query_id, count(*) AS n, CAST(sum(cited) AS BIGINT) AS k FROM candidates GROUP BY query_id) c ON m.query_id = c.query_id""",
)
def mart_queries(spark: SparkSession, folder: str) -> DataFrame:
    facts = candidates(spark, folder).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("cited").alias("k"))
    names = F.create_map(F.lit(1), F.lit("Yes"), F.lit(0), F.lit("No"))
    joined = query_meta(spark, folder).withColumn("segment", segment()).join(facts, "query_id", "left")
    return joined.select(
        "query_id",
        "query",
        "segment",
        names[F.col("ai_overview_present")].alias("has_overview"),
        F.coalesce("n", F.lit(0)).alias("candidates"),
        F.coalesce("k", F.lit(0)).alias("citations"),
        F.round(F.coalesce(F.col("k") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 6).alias("rate"),
    )


@query(
    "mart_pages",
    f"SELECT row_id, query_id, url, {SQL_DOMAIN} AS domain, organic_rank, CASE cited WHEN 1 THEN 'Yes' ELSE 'No' END AS cited, content_type FROM candidates WHERE organic_rank <> 101",
)
def mart_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder).where(ranked())
    cited = F.when(F.col("cited") == 1, "Yes").otherwise("No")
    return rows.select("row_id", "query_id", "url", domain().alias("domain"), "organic_rank", cited.alias("cited"), "content_type")


@query(
    "mart_domains",
    f"SELECT domain, pages, citations, round(citations / pages::double, 6) AS rate, queries FROM (SELECT {SQL_DOMAIN} AS domain, count(*) AS pages, CAST(sum(cited) AS BIGINT) AS citations, "
    "count(DISTINCT query_id) AS queries FROM candidates WHERE organic_rank <> 101 GROUP BY 1) WHERE domain IS NOT NULL AND pages >= 5",
)
def mart_domains(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder).where(ranked()).withColumn("domain", domain())
    each = rows.where("domain is not null").groupBy("domain").agg(
        F.count("*").alias("pages"), F.sum("cited").alias("citations"), F.countDistinct("query_id").alias("queries")
    )
    return each.where("pages >= 5").select("domain", "pages", "citations", F.round(F.col("citations") / F.col("pages"), 6).alias("rate"), "queries")


_PARTS = ["has_schema", "has_faq", "is_https", "is_forum", "is_video"]


@query(
    "mart_features",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count_if({f} = 1) AS pages_with, round(avg(CASE WHEN {f} = 1 THEN cited END), 6) AS rate_with, "
        f"round(avg(CASE WHEN {f} = 0 THEN cited END), 6) AS rate_without FROM candidates WHERE organic_rank <> 101"
        for f in _PARTS
    ),
)
def mart_features(spark: SparkSession, folder: str) -> DataFrame:
    long = candidates(spark, folder).where(ranked()).unpivot(["cited"], _PARTS, "feature", "v")
    on, off = F.col("v") == 1, F.col("v") == 0
    return long.groupBy("feature").agg(
        F.count_if(on).alias("pages_with"),
        F.round(F.avg(F.when(on, F.col("cited"))), 6).alias("rate_with"),
        F.round(F.avg(F.when(off, F.col("cited"))), 6).alias("rate_without"),
    )


@query(
    "mart_questions",
    _R + ", q AS (SELECT serp_id, unnest(CAST(json_extract(x, '$.items[*]') AS JSON[])) AS y FROM ii WHERE type = 'people_also_ask'), "
    "p AS (SELECT serp_id, y->>'$.title' AS question FROM q WHERE trim(coalesce(y->>'$.title', '')) <> '') "
    "SELECT serp_id, question, count(*) OVER (PARTITION BY lower(trim(question, ' '))) AS times FROM p",
)
def mart_questions(spark: SparkSession, folder: str) -> DataFrame:
    q = paa_questions(spark, folder)
    counts = q.groupBy(F.lower(F.trim("question")).alias("key")).agg(F.count("*").alias("times"))
    return q.withColumn("key", F.lower(F.trim("question"))).join(counts, "key").select("serp_id", "question", "times")


@query(
    "gap_quantile",
    "SELECT row_id, CAST(passage_match_score >= q AND cited = 0 AS INTEGER) AS gap FROM candidates, (SELECT quantile_cont(passage_match_score, 0.75) AS q FROM candidates) "
    "WHERE passage_match_score IS NOT NULL",
)
def gap_quantile(spark: SparkSession, folder: str) -> DataFrame:
    """Uncited rows in the top quarter of a score."""
    df = candidates(spark, folder).where("passage_match_score is not null")
    upper = ranges.quantiles(df, "passage_match_score", [0.75]).select(F.get("q", 0).alias("q"))
    gap = (F.col("passage_match_score") >= F.col("q")) & (F.col("cited") == 0)
    return df.crossJoin(F.broadcast(upper)).select("row_id", gap.cast("int").alias("gap"))


@query("reuse_permutation_null")
def reuse_permutation_null(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of an answer sentence and its source that share an 8-gram, against sources of other rows, 1,000 times.

    A replicate pairs each row with the source of another one, by a hash that never picks the row itself: positions in a
    fixed order are shifted by 1 to n - 1.
    """
    from citelens.functions import text as T

    rows = table(spark, folder, "passage_matches_ngram").where("aio_sentence is not null and source_sentence is not null")
    places = validation.dense_ranks(rows, "match_id")
    both = rows.join(places, "match_id").select("rank", T.tokens(F.col("aio_sentence")).alias("a"), T.tokens(F.col("source_sentence")).alias("b"))
    grams = both.select("rank", T.ngrams(F.col("a"), 8).alias("a"), T.ngrams(F.col("b"), 8).alias("b"))
    total = grams.agg(F.count("*").alias("n"))
    seen = grams.agg(F.count_if(F.arrays_overlap("a", "b")).alias("observed"))
    reps = grams.select("rank", "a").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(1000)))).crossJoin(F.broadcast(total))
    shift = 1 + F.pmod(F.xxhash64("rep", F.lit(3)), F.greatest(F.col("n") - 1, F.lit(1)))
    paired = reps.withColumn("other", F.pmod(F.col("rank") + shift, F.col("n"))).join(
        grams.select(F.col("rank").alias("other"), "b"), "other"
    )
    null = paired.groupBy("rep").agg(F.count_if(F.arrays_overlap("a", "b")).alias("c"))
    return null.crossJoin(F.broadcast(seen)).agg(
        F.max("observed").alias("observed"),
        F.avg("c").alias("null_mean"),
        F.percentile("c", F.lit(0.025)).alias("low"),
        F.percentile("c", F.lit(0.975)).alias("high"),
        ((F.count_if(F.col("c") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p"),
    )


@query("trait_tests")
def trait_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Traits of reused answer sentences against the others, by Fisher's test with Holm's adjustment.

    A sentence is reused if it shares an 8-gram with its source; the two groups are limited to the lengths between the 10 %
    and 90 % quantiles of the reused ones where their medians differ by more than 2 words.
    """
    from citelens.functions import text as T

    rows = table(spark, folder, "passage_matches_ngram").where("aio_sentence is not null and source_sentence is not null")
    t = T.traits(F.col("aio_sentence"))
    x = rows.select(T.tokens(F.col("aio_sentence")).alias("a"), T.tokens(F.col("source_sentence")).alias("b"), *[c.alias(k) for k, c in t.items()])
    reused = F.arrays_overlap(T.ngrams(F.col("a"), 8), T.ngrams(F.col("b"), 8)).cast("int")
    x = x.withColumn("reused", reused).drop("a", "b")
    on = F.when(F.col("reused") == 1, F.col("n_words"))
    off = F.when(F.col("reused") == 0, F.col("n_words"))
    limits = x.agg(
        F.percentile(on, F.lit(0.1)).alias("q10"), F.percentile(on, F.lit(0.9)).alias("q90"), F.abs(F.median(on) - F.median(off)).alias("apart")
    )
    inside = (F.col("apart") <= 2) | F.col("n_words").between(F.col("q10"), F.col("q90"))
    kept = x.crossJoin(F.broadcast(limits)).where(inside)
    flags = [k for k in t if k != "n_words"]
    return inference.holm(inference.fisher(inference.contingency(kept, flags, "reused")), "p")


@query("synthetic_candidates")
def synthetic(spark: SparkSession, folder: str) -> DataFrame:
    return synthetic_candidates(spark)


@query(
    "balanced_folds",
    "WITH RECURSIVE s AS (SELECT query_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, query_id) AS i FROM candidates WHERE query_id IS NOT NULL GROUP BY query_id), "
    "r AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS query_id, 0::BIGINT AS n, NULL::INTEGER AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL "
    "SELECT s.i, s.query_id, s.n, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, j: x + CASE WHEN j = list_position(loads, list_min(loads)) THEN s.n ELSE 0 END) "
    "FROM r JOIN s ON s.i = r.i + 1) SELECT query_id, CAST(fold AS INTEGER) AS fold FROM r WHERE i > 0",
)
def balanced_folds(spark: SparkSession, folder: str) -> DataFrame:
    """The fold of each query when queries are dealt out by size."""
    return validation.balanced_folds(candidates(spark, folder), "query_id", 5)


@query(
    "quota_keep_first",
    "WITH o AS (SELECT row_id, query_id, cited, organic_rank FROM candidates QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY organic_rank NULLS FIRST, row_id) = 1) "
    "SELECT row_id, query_id, cited FROM o WHERE cited = 1 UNION ALL SELECT row_id, query_id, cited FROM (SELECT * FROM o WHERE cited IS DISTINCT FROM 1 "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY organic_rank NULLS FIRST, row_id) <= 5)",
)
def quota_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates, each url once a query, under the quota of uncited rows."""
    order = [F.col("organic_rank"), F.col("row_id")]
    once = relational.keep_first(candidates(spark, folder), ["query_id", "url"], order)
    return relational.quota(once, ["query_id"], order, F.col("cited") == 1, 5).select("row_id", "query_id", "cited")


@query(
    "streamed_event_windows",
    "SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def streamed_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly windows from a stream of the events table, run to its end; equal to the batch result.

    Windows are written as they change, each micro-batch to a folder of its own, and leave the state once the watermark has
    passed them; the last state of a window counts.
    """
    import uuid

    from citelens.staging import shared_folder
    from citelens.streaming.incremental import event_windows, latest

    path = f"{folder}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if _is_folder(spark, path) else f"{folder}/events*.parquet")
    target = f"{shared_folder(spark)}/citelens/stream-{uuid.uuid4().hex}"
    run = (
        event_windows(stream, late="40 days")
        .writeStream.outputMode("update")
        .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{target}/batch={batch}"))
        .option("checkpointLocation", target + "-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return latest(spark.read.parquet(target), ["start", "event_type"], "batch").withColumn("total", F.round("total", 4))


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
