"""Report tables over candidates, answers, pages and transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.functions import html, serp
from citelens.functions import text as T
from citelens.functions import url as U
from citelens.operators import inference, ranges, relational, windows
from citelens.plans.candidate_queries import SQL_DOMAIN, domain, query_meta, ranked
from citelens.plans.registry import query
from citelens.plans.tables import candidates, table
from citelens.plans.text_queries import _SNIPPETS_SQL, _content_sql, sql_ngrams, sql_tokens, sql_words, transcripts
from citelens.staging import stage


def _share(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


@query(
    "citations_without_ranking",
    "SELECT query_id, count(*) AS cited, count(*) FILTER (organic_rank = 101) AS unranked, round(count(*) FILTER (organic_rank = 101) / count(*)::double, 6) AS share "
    "FROM candidates WHERE cited = 1 GROUP BY query_id HAVING count(*) >= 6 AND count(*) FILTER (organic_rank <> 101) >= 2",
)
def citations_without_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Queries with six or more citations, two of them ranked, and the share of their citations outside the ranking."""
    each = candidates(spark, folder).where("cited = 1").groupBy("query_id").agg(F.count("*").alias("cited"), F.count_if(~ranked()).alias("unranked"))
    enough = each.where((F.col("cited") >= 6) & (F.col("cited") - F.col("unranked") >= 2))
    return enough.select("query_id", "cited", "unranked", _share(F.col("unranked"), F.col("cited")).alias("share"))


@query(
    "site_citation_slots",
    f"WITH c AS (SELECT query_id, organic_rank, {SQL_DOMAIN} AS d FROM candidates WHERE cited = 1), t AS (SELECT count(DISTINCT query_id) AS q, count(*) AS n FROM c) "
    "SELECT d AS domain, count(DISTINCT query_id) AS queries, round(count(DISTINCT query_id) / any_value(q)::double, 6) AS query_share, count(*) AS citations, "
    "round(count(*) / any_value(n)::double, 6) AS citation_share, round(count(*) FILTER (organic_rank = 101) / count(*)::double, 6) AS unranked_share FROM c, t WHERE d IS NOT NULL GROUP BY d",
)
def site_citation_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Of each site: the answers that cite it, its share of all citations, and the share of these outside the ranking."""
    cited = candidates(spark, folder).where("cited = 1").withColumn("domain", domain())
    total = cited.agg(F.countDistinct("query_id").alias("q"), F.count("*").alias("n"))
    each = cited.where("domain is not null").groupBy("domain").agg(
        F.countDistinct("query_id").alias("queries"), F.count("*").alias("citations"), F.count_if(~ranked()).alias("unranked")
    )
    return each.crossJoin(F.broadcast(total)).select(
        "domain", "queries", _share(F.col("queries"), F.col("q")).alias("query_share"), "citations",
        _share(F.col("citations"), F.col("n")).alias("citation_share"), _share(F.col("unranked"), F.col("citations")).alias("unranked_share"),
    )


_STRONG = 10  # sites with the most citations stand for the established ones


@query(
    "rate_by_position_and_site",
    f"WITH c AS (SELECT query_id, organic_rank, cited, {SQL_DOMAIN} AS d FROM candidates WHERE organic_rank <> 101), a AS (SELECT * FROM c WHERE query_id IN (SELECT query_id FROM c WHERE cited > 0)), "
    f"s AS (SELECT d FROM c WHERE cited = 1 AND d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT {_STRONG}) "
    "SELECT organic_rank, round(avg(cited) FILTER (d IN (FROM s)), 6) AS established, round(avg(cited) FILTER (d IS NULL OR d NOT IN (FROM s)), 6) AS others FROM a WHERE organic_rank <= 10 GROUP BY organic_rank",
)
def rate_by_position_and_site(spark: SparkSession, folder: str) -> DataFrame:
    """Citation rate at each of the first ten positions, of the ten most cited sites and of the others, in queries with a citation."""
    rows = candidates(spark, folder).where(ranked()).withColumn("domain", domain())
    counts = rows.where("cited = 1 and domain is not null").groupBy("domain").agg(F.count("*").alias("n"))
    strong = counts.orderBy(F.desc("n"), "domain").limit(_STRONG).select("domain")
    having = rows.where("cited > 0").select("query_id").distinct()
    marked = relational.mark_join(rows.where("organic_rank <= 10").join(having, "query_id", "left_semi"), strong, ["domain"], "strong")
    on = F.col("strong") == 1
    return marked.groupBy("organic_rank").agg(
        F.round(F.avg(F.when(on, F.col("cited"))), 6).alias("established"), F.round(F.avg(F.when(~on, F.col("cited"))), 6).alias("others")
    )


@query(
    "longest_reuses",
    "SELECT source_sentence, match_id, shared_run_words FROM (SELECT *, row_number() OVER (PARTITION BY source_sentence ORDER BY match_id) AS r FROM passage_matches_ngram WHERE source_sentence IS NOT NULL) "
    "WHERE r = 1 AND shared_run_words IS NOT NULL ORDER BY shared_run_words DESC, match_id LIMIT 4",
)
def longest_reuses(spark: SparkSession, folder: str) -> DataFrame:
    """The four distinct source sentences with the longest stored runs: a report of the top four."""
    rows = table(spark, folder, "passage_matches_ngram").where("source_sentence is not null")
    first = rows.groupBy("source_sentence").agg(F.min_by(F.struct("match_id", "shared_run_words"), "match_id").alias("x")).select("source_sentence", "x.*")
    return first.where("shared_run_words is not null").orderBy(F.desc("shared_run_words"), "match_id").limit(4)


@query(
    "feature_with_answer",
    "WITH m AS (SELECT * FROM query_meta QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY query NULLS LAST) = 1) "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) AS queries, CAST(coalesce(sum(ai_overview_present), 0) AS BIGINT) AS with_answer FROM m WHERE {f} = 1"
        for f in ("has_local_pack", "has_map", "has_shopping", "has_video")
    ),
)
def feature_with_answer(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the searches that show a feature have an answer at all."""
    names = ["has_local_pack", "has_map", "has_shopping", "has_video"]
    parts = [
        query_meta(spark, folder).where(F.col(f) == 1).agg(
            F.lit(f).alias("feature"), F.count("*").alias("queries"), F.coalesce(F.sum("ai_overview_present"), F.lit(0)).alias("with_answer")
        )
        for f in names
    ]
    return reduce(DataFrame.unionByName, parts)


# --- alignment of cited seconds with transcripts ---------------------------------------------------------------------------

LENGTH, STEP = 45.0, 15.0


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from an md5 that SQL engines agree on."""
    return F.conv(F.left(F.md5(F.concat_ws("|", *parts)), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def answer_words(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, words): content words of each query's first answer; queries without any are left out."""
    passages = table(spark, folder, "passage_matches_ngram").where("aio_sentence is not null and query_id is not null")
    first = passages.groupBy("query_id").agg(F.min_by("aio_sentence", "match_id").alias("s"))
    return first.select("query_id", T.content_words(T.clean_markdown(F.col("s"))).alias("words")).where(F.size("words") > 0)


def alignment(cited: DataFrame, snippets: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, doc_id, cited_at, duration, best_start, score, gap, unrelated_gap, random_gap).

    ``cited`` are (query_id, cited_at), ``snippets`` (doc_id, query_id, snippets), ``answers`` (query_id, words). The gap is the
    distance from the cited second to the window that has most of the answer's words; the baselines take the words of the
    query that follows in a hashed order, and a point by a hash. Transcripts of fewer than three windows are left out.
    """
    wins = stage(windows.sliding_windows(snippets, "doc_id", "snippets", LENGTH, STEP), "alignment-windows")
    long = wins.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("start").alias("last")).where("n >= 3")
    placed = ranges.positions(answers.withColumn("_h", F.md5("query_id")), ["_h", "query_id"])
    total = placed.agg(F.count("*").alias("_n"))
    others = placed.select(F.col("rank").alias("_next"), F.col("words").alias("other_words"))
    following = placed.crossJoin(F.broadcast(total)).withColumn("_next", F.pmod(F.col("rank") + 1, F.col("_n"))).join(others, "_next")
    cases = cited.join(snippets.select("doc_id", "query_id"), "query_id").join(long, "doc_id").join(following.select("query_id", "words", "other_words"), "query_id")
    cases = stage(cases.select("query_id", "doc_id", "cited_at", (F.col("last") + LENGTH).alias("duration"), "words", "other_words"), "alignment-cases")
    target = cases.select("doc_id", "query_id", "words", "other_words")
    real = windows.best_window(wins, "doc_id", target.select("doc_id", "words"), "words")
    fake = windows.best_window(wins, "doc_id", target.select("doc_id", "other_words"), "other_words").select("doc_id", F.col("best_start").alias("other_start"))
    at = F.col("duration") * _unit(F.col("query_id"), F.col("doc_id").cast("string"))
    return cases.join(real, "doc_id").join(fake, "doc_id").select(
        "query_id", "doc_id", "cited_at", "duration", "best_start", "score",
        F.abs(F.col("best_start") - F.col("cited_at")).alias("gap"),
        F.abs(F.col("other_start") - F.col("cited_at")).alias("unrelated_gap"),
        F.abs(at - F.col("cited_at")).alias("random_gap"),
    )


_ALIGNED = (
    _SNIPPETS_SQL
    + ", w0 AS (SELECT doc_id, i, text, t, unnest(range(CAST(greatest(0, floor((t - 45) / 15) + 1) AS BIGINT), CAST(floor(t / 15) AS BIGINT) + 1)) AS k FROM s), "
    "w AS (SELECT doc_id, k * 15.0::double AS start, string_agg(text, ' ' ORDER BY i) AS text FROM w0 GROUP BY doc_id, k HAVING trim(string_agg(text, ' ' ORDER BY i), ' ') <> ''), "
    "l AS (SELECT doc_id, max(start) + 45 AS duration FROM w GROUP BY doc_id HAVING count(*) >= 3), "
    "f AS (SELECT query_id, arg_min(aio_sentence, match_id) AS s FROM passage_matches_ngram WHERE aio_sentence IS NOT NULL AND query_id IS NOT NULL GROUP BY query_id), "
    f"a0 AS (SELECT query_id, {_content_sql('s')} AS words FROM f), a AS (SELECT query_id, words, coalesce(lead(words) OVER o, first_value(words) OVER o) AS other FROM a0 WHERE len(words) > 0 "
    "WINDOW o AS (ORDER BY md5(query_id), query_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "c AS (SELECT query_id, min(CAST(regexp_extract(url, '[?&]t=(\\d+)', 1) AS DOUBLE)) AS cited_at FROM candidates WHERE cited = 1 AND regexp_matches(url, '[?&]t=\\d+') AND query_id IS NOT NULL GROUP BY query_id), "
    "k AS (SELECT c.query_id, d.doc_id, cited_at, duration, words, other FROM c JOIN documents d ON d.query_id = c.query_id AND d.kind = 'transcript' JOIN l ON l.doc_id = d.doc_id JOIN a ON a.query_id = c.query_id), "
    f"wc AS (SELECT w.doc_id, start, {_content_sql('text')} AS own FROM w JOIN (SELECT DISTINCT doc_id FROM k) USING (doc_id)), "
    "sc AS (SELECT k.doc_id, start, CASE WHEN len(list_intersect(own, words)) > 0 THEN round(len(list_intersect(own, words)) / sqrt(len(own)), 12) ELSE 0 END AS s1, "
    "CASE WHEN len(list_intersect(own, other)) > 0 THEN round(len(list_intersect(own, other)) / sqrt(len(own)), 12) ELSE 0 END AS s2 FROM k JOIN wc ON wc.doc_id = k.doc_id), "
    "b AS (SELECT doc_id, CASE WHEN max(s1) > 0 THEN arg_max(start, struct_pack(a := s1, b := -start)) ELSE 0 END AS b1, CASE WHEN max(s2) > 0 THEN arg_max(start, struct_pack(a := s2, b := -start)) ELSE 0 END AS b2 FROM sc GROUP BY doc_id), "
    "g AS (SELECT k.doc_id, abs(b1 - cited_at) AS gap, abs(b2 - cited_at) AS unrelated_gap, "
    "abs(duration * (('0x' || left(md5(query_id || '|' || CAST(k.doc_id AS VARCHAR)), 8))::BIGINT / 4294967296.0::double) - cited_at) AS random_gap FROM k JOIN b ON b.doc_id = k.doc_id) "
)


@query(
    "video_alignment",
    _ALIGNED
    + " UNION ALL ".join(
        f"SELECT '{c}' AS baseline, count(*) AS n, round(median({c}), 3) AS median_gap, round(avg(CAST({c} <= 60 AS INTEGER)), 6) AS within_60, round(avg(CAST({c} <= 90 AS INTEGER)), 6) AS within_90, "
        f"CASE WHEN count(*) > 0 THEN count_if({c} > 90) END AS beyond FROM g"
        for c in ("gap", "unrelated_gap", "random_gap")
    ),
)
def video_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """(baseline, n, median_gap, within_60, within_90, beyond): how near the cited second is to the words of the answer."""
    at = U.offset_seconds(F.col("url")).cast("double")
    rows = candidates(spark, folder).where("cited = 1 and query_id is not null").withColumn("at", at).where("at is not null")
    cited = rows.groupBy("query_id").agg(F.min("at").alias("cited_at"))
    documents = table(spark, folder, "documents").select("doc_id", "query_id").where("query_id is not null")
    gaps = stage(alignment(cited, transcripts(spark, folder).join(documents, "doc_id"), answer_words(spark, folder)), "alignment-gaps")
    names = ["gap", "unrelated_gap", "random_gap"]
    long = gaps.unpivot([], names, "baseline", "v")
    middle = ranges.quantiles(long, "v", [0.5], ["baseline"]).select("baseline", F.round(F.get("q", 0), 3).alias("median_gap"))
    parts = [
        gaps.agg(
            F.lit(c).alias("baseline"), F.count("*").alias("n"), F.round(F.avg((F.col(c) <= 60).cast("int")), 6).alias("within_60"),
            F.round(F.avg((F.col(c) <= 90).cast("int")), 6).alias("within_90"), F.count_if(F.col(c) > 90).alias("beyond"),
        )
        for c in names
    ]
    shares = reduce(DataFrame.unionByName, parts).withColumn("beyond", F.when(F.col("n") > 0, F.col("beyond")))
    return shares.join(middle, "baseline", "left").select("baseline", "n", "median_gap", "within_60", "within_90", "beyond")


# --- reused sentences against others of the same pages -------------------------------------------------------------------


def reused_and_controls(answers: DataFrame, sentences: DataFrame, controls: int = 5, n: int = 8) -> DataFrame:
    """(page_id, sentence, reused): page sentences that share an n-gram with an answer sentence of their query, and up to
    ``controls`` others of each page that has such a sentence, in the order of a hash.

    ``answers`` are (query_id, aio_sentence), ``sentences`` (page_id, query_id, sentence). A sentence that is reused anywhere is
    no control.
    """

    def grams(df: DataFrame, text: str, *keep: str) -> DataFrame:
        split = df.select(*keep, T.tokens(F.col(text)).alias("tokens"))
        return split.select(*keep, F.explode(T.ngrams(F.col("tokens"), n)).alias("gram"))

    told = grams(answers, "aio_sentence", "query_id").distinct()
    reused = stage(grams(sentences, "sentence", "page_id", "query_id", "sentence").join(told, ["query_id", "gram"], "left_semi").select("page_id", "sentence").distinct(), "reused-sentences")
    pages = reused.select("page_id").distinct()
    rest = sentences.select("page_id", "sentence").distinct().join(pages, "page_id", "left_semi").join(reused.select("sentence").distinct(), "sentence", "left_anti")
    picked = relational.top_k(rest, ["page_id"], [F.md5("sentence"), F.col("sentence")], controls).drop("position")
    lifted = reused.select("sentence").distinct().select(F.lit(None).cast("bigint").alias("page_id"), "sentence", F.lit(1).alias("reused"))
    return lifted.unionByName(picked.select("page_id", "sentence", F.lit(0).alias("reused")))


@query("matched_trait_tests")
def matched_trait_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Traits of reused page sentences against up to five others of the same pages, by Fisher's test with Holm's adjustment.

    Both groups are limited to the lengths between the 10 % and 90 % quantiles of the reused ones where their medians differ by
    more than 2 words.
    """
    pages = table(spark, folder, "page_content").where("ok and length(html) > 0 and query_id is not null")
    parsed = pages.select("page_id", "query_id", html.parsed_page("html").alias("p"))
    sentences = stage(parsed.select("page_id", "query_id", F.explode(T.sentences(F.col("p.text"))).alias("sentence")), "page-sentences")
    answers = table(spark, folder, "passage_matches_ngram").where("aio_sentence is not null").select("query_id", "aio_sentence")
    both = reused_and_controls(answers, sentences)
    traits = T.traits(F.col("sentence"))
    x = stage(both.select("reused", *[c.alias(k) for k, c in traits.items()]), "sentence-traits")
    lengths = ranges.quantiles(x, "n_words", [0.1, 0.5, 0.9], ["reused"])
    on, off = (F.max(F.when(F.col("reused") == k, F.col("q"))) for k in (1, 0))
    limits = lengths.agg(on.alias("on"), off.alias("off"))
    apart = F.abs(F.get("on", 1) - F.get("off", 1)) > 2
    inside = ~F.coalesce(apart, F.lit(False)) | F.col("n_words").between(F.get("on", 0), F.get("on", 2))
    kept = x.crossJoin(F.broadcast(limits)).where(inside)
    return inference.holm(inference.fisher(inference.contingency(kept, [k for k in traits if k != "n_words"], "reused")), "p")


@query(
    "reused_sentences",
    f"WITH a AS (SELECT DISTINCT query_id, unnest({sql_ngrams('t', 8)}) AS g FROM (SELECT query_id, {sql_tokens('aio_sentence')} AS t FROM passage_matches_ngram WHERE aio_sentence IS NOT NULL)), "
    f"b AS (SELECT match_id, query_id, unnest({sql_ngrams('t', 8)}) AS g FROM (SELECT match_id, query_id, {sql_tokens('source_sentence')} AS t FROM passage_matches_ngram WHERE source_sentence IS NOT NULL)) "
    "SELECT DISTINCT match_id FROM b JOIN a ON a.query_id = b.query_id AND a.g = b.g",
)
def reused_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Source sentences that share an 8-gram with any answer sentence of their query."""
    p = table(spark, folder, "passage_matches_ngram")

    def grams(text: str, *keep: str) -> DataFrame:
        split = p.where(F.col(text).isNotNull()).select(*keep, T.tokens(F.col(text)).alias("tokens"))
        return split.select(*keep, F.explode(T.ngrams(F.col("tokens"), 8)).alias("gram"))

    told = grams("aio_sentence", "query_id").distinct()
    return grams("source_sentence", "match_id", "query_id").join(told, ["query_id", "gram"], "left_semi").select("match_id").distinct()


# --- rows of candidates from responses and pages -------------------------------------------------------------------------

AUTHORITY = 50.0  # a neutral constant for both authority columns


def assembled(found: DataFrame, pages: DataFrame, as_of: str) -> DataFrame:
    """The contractual columns, then title, snippet and crawl_ok, of each candidate of a response.

    ``found`` are (query_id, query, url, organic_rank, title, snippet, cited), ``pages`` (query_id, url, html, ok). A page is
    met by its query and url key; the last of repeated crawls that went well counts. Texts are compared with the page's text,
    or with title and snippet where there is none. Citation rates of domains are filled in by ``streaming.finalise``.
    """
    key = ["query_id", "_k"]
    crawled = pages.withColumn("_k", U.repair_key(F.col("url"))).groupBy(*key).agg(
        F.max_by(F.struct("html", "ok"), F.struct((F.col("ok") & (F.length("html") > 0)).cast("int"), "page_id")).alias("c")
    )
    met = found.withColumn("_k", U.repair_key(F.col("url"))).join(crawled, key, "left").select(
        "query_id", "query", "url", "organic_rank", F.col("title").alias("hint"), "snippet", "cited", F.col("c.html").alias("html"), F.coalesce("c.ok", F.lit(False)).alias("ok")
    )
    features = html.onpage_features(met.withColumn("address", F.col("url")), as_of, "query_id", "query", "address", "organic_rank", "hint", "snippet", "cited", "ok")
    named = features.withColumn("shown", F.coalesce("hint", "title"))
    text = F.coalesce(F.nullif("page_text", F.lit("")), F.concat_ws(" ", F.coalesce("hint", F.lit("")), F.coalesce("snippet", F.lit(""))))
    scored = named.withColumn("_text", text).withColumn("_s", T.query_similarity(F.col("query"), F.col("_text")))
    return scored.select(
        "query_id", "query", F.col("address").alias("url"), "organic_rank", F.lit(AUTHORITY).alias("domain_rating"), F.lit(AUTHORITY).alias("page_authority"),
        "word_count", "has_schema", "num_lists_tables", "has_faq", F.round("_s.whole", 3).alias("query_url_similarity"), F.round("_s.best", 3).alias("passage_match_score"),
        F.col("content_freshness_days").cast("int").alias("content_freshness_days"), T.entity_overlap(F.col("query"), F.col("_text")).alias("num_entities_matched"),
        "readability_score", "is_https", F.lit(None).cast("double").alias("domain_citation_rate"), "is_forum", "is_video", "content_type", "cited",
        F.col("shown").alias("title"), "snippet", F.col("ok").cast("int").alias("crawl_ok"),
    )


@query("assembled_candidates")
def assembled_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate rows from the stored responses and crawled pages: response, page and text features joined."""
    responses = serp.results(table(spark, folder, "serp_sample").select("serp_id", "query_id", "body"), "body")
    keyword = F.col("result.keyword")
    named = responses.select("serp_id", "query_id", keyword.alias("query"))
    found = serp.candidates(responses, "serp_id", U.repair_key).join(named, "serp_id")
    return assembled(found, table(spark, folder, "page_content"), "2026-07-17")


@query(
    "page_or_snippet",
    "WITH c AS (SELECT row_id, query_id, candidate_idx, nullif(trim(concat_ws(' ', title, snippet), ' '), '') AS s FROM candidates), "
    "d AS (SELECT query_id, arg_min(text, doc_id) AS t FROM documents WHERE kind = 'page_text' AND text IS NOT NULL AND query_id IS NOT NULL GROUP BY query_id), "
    f"x AS (SELECT row_id, CASE WHEN {sql_words("coalesce(t, '')")} >= 30 THEN t ELSE s END AS text, {sql_words("coalesce(t, '')")} >= 30 AS page FROM c LEFT JOIN d ON c.query_id = d.query_id) "
    f"SELECT row_id, page, CAST({sql_words('text')} AS INTEGER) AS n_words FROM x WHERE {sql_words("coalesce(text, '')")} >= 10",
)
def page_or_snippet(spark: SparkSession, folder: str) -> DataFrame:
    """The text that stands for a candidate: its query's first page text of 30 words or more, else title and snippet; texts
    under 10 words are left out."""
    rows = candidates(spark, folder).select("row_id", "query_id", F.nullif(F.trim(F.concat_ws(" ", "title", "snippet")), F.lit("")).alias("s"))
    documents = table(spark, folder, "documents").where("kind = 'page_text' and text is not null and query_id is not null")
    first = documents.groupBy("query_id").agg(F.min_by("text", "doc_id").alias("t"))
    return T.text_or_else(rows.join(first, "query_id", "left"), "t", "s", 30, 10).select("row_id", "page", "n_words")
