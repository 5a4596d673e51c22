"""Queries of the text functions, of similarity and of time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.functions import text as T
from citelens.operators import similarity, windows
from citelens.plans.registry import query
from citelens.plans.tables import table
from citelens.staging import stage

_S = "[ \\t\\n\\x0B\\f\\r]+"
_TOKENS = "[a-zäöüßA-ZÄÖÜ0-9€%.,-]+"


def sql_words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{_S}'), lambda w: w <> ''))"


def sql_sentences(x: str, least: int = 6) -> str:
    split = f"string_split_regex(regexp_replace({x}, '([.!?]){_S}', '\\1' || chr(1), 'g'), chr(1))"
    trimmed = f"list_transform({split}, lambda p: trim(p, ' '))"
    return f"list_filter({trimmed}, lambda p: len(list_filter(string_split_regex(p, '{_S}'), lambda w: w <> '')) >= {least})"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{_TOKENS}')"


def sql_ngrams(tokens: str, n: int) -> str:
    return (
        f"CASE WHEN len({tokens}) >= {n} THEN list_distinct(list_transform(range(1, len({tokens}) - {n} + 2), "
        f"lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))) ELSE [] END"
    )


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "passage_matches_ngram")


@query(
    "word_counts",
    f"SELECT doc_id, CAST({sql_words('text')} AS INTEGER) AS n_words, CAST(len({sql_tokens('text')}) AS INTEGER) AS n_tokens, "
    f"CAST(len({sql_sentences('text')}) AS INTEGER) AS n_sentences, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE text IS NOT NULL",
)
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("text")
    return _documents(spark, folder).where("text is not null").select(
        "doc_id",
        T.word_count(x).alias("n_words"),
        F.size(T.tokens(x)).alias("n_tokens"),
        F.size(T.sentences(x)).alias("n_sentences"),
        F.length(x).alias("n_chars"),
    )


@query(
    "sentence_split",
    f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM "
    f"(SELECT doc_id, {sql_sentences('text')} AS s FROM documents WHERE text IS NOT NULL))",
)
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    "clean_markdown",
    "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    "'\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\*\\*([^*]*)\\*\\*', '\\1', 'g'), '\\*([^*]*)\\*', '\\1', 'g'), '\\[+\\d*\\]+', ' ', 'g'), "
    f"'\\(https?://[^)]*\\)', ' ', 'g'), 'https?://[^ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '{_S}', ' ', 'g'), ' ') AS cleaned FROM documents WHERE text IS NOT NULL",
)
def clean_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).where("text is not null").select("doc_id", T.clean_markdown(F.col("text")).alias("cleaned"))


def _cue_sql(cues: tuple[str, ...]) -> str:
    return "CAST((" + " OR ".join(f"contains(lower(s), '{c}')" for c in cues) + ") AS INTEGER)"


@query(
    "sentence_traits",
    f"WITH x AS (SELECT match_id, aio_sentence AS s FROM passage_matches_ngram WHERE aio_sentence IS NOT NULL) SELECT match_id, CAST({sql_words('s')} AS INTEGER) AS n_words, "
    "CAST(regexp_matches(s, '[0-9]') AS INTEGER) AS has_number, CAST(regexp_matches(lower(s), '(euro|€|\\beur\\b)') AS INTEGER) AS has_currency, "
    "CAST((contains(s, '%') OR contains(lower(s), 'prozent')) AS INTEGER) AS has_percent, CAST(regexp_matches(s, '=|×|\\*|\\+') AS INTEGER) AS has_formula, "
    f"{_cue_sql(T.DEFINITION_CUES)} AS has_definition_cue, {_cue_sql(T.LIST_CUES)} AS has_list_cue, "
    "CAST((upper(left(s, 1)) = left(s, 1) AND lower(left(s, 1)) <> left(s, 1)) AS INTEGER) AS starts_capital FROM x",
)
def sentence_traits(spark: SparkSession, folder: str) -> DataFrame:
    named = [c.alias(k) for k, c in T.traits(F.col("aio_sentence")).items()]
    return _passages(spark, folder).where("aio_sentence is not null").select("match_id", *named)


@query(
    "token_ngrams",
    f"SELECT doc_id, CAST(len({sql_ngrams('t', 8)}) AS INTEGER) AS n_grams FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)",
)
def token_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    x = _documents(spark, folder).where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return x.select("doc_id", F.size(T.ngrams(F.col("t"), 8)).alias("n_grams"))


@query(
    "entity_overlap",
    "SELECT match_id, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(query), '[a-zäöüß]{4,}')), lambda t: contains(lower(source_sentence), t))) AS INTEGER) AS n "
    "FROM passage_matches_ngram WHERE query IS NOT NULL AND source_sentence IS NOT NULL",
)
def entity_overlap(spark: SparkSession, folder: str) -> DataFrame:
    rows = _passages(spark, folder).where("query is not null and source_sentence is not null")
    return rows.select("match_id", T.entity_overlap(F.col("query"), F.col("source_sentence")).alias("n"))


def _content_sql(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-zäöüßA-ZÄÖÜ0-9]{{3,}}')), lambda w: NOT list_contains([{stops}], w))"


@query(
    "content_word_overlap",
    f"SELECT match_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS common, round(len(list_intersect(a, b)) / sqrt(nullif(len(b), 0)), 6) AS score FROM "
    f"(SELECT match_id, {_content_sql('aio_sentence')} AS a, {_content_sql('source_sentence')} AS b FROM passage_matches_ngram "
    "WHERE aio_sentence IS NOT NULL AND source_sentence IS NOT NULL)",
)
def content_word_overlap(spark: SparkSession, folder: str) -> DataFrame:
    rows = _passages(spark, folder).where("aio_sentence is not null and source_sentence is not null")
    a, b = T.content_words(F.col("aio_sentence")), T.content_words(F.col("source_sentence"))
    words = rows.select("match_id", a.alias("a"), b.alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return words.select("match_id", common.alias("common"), F.round(common / F.sqrt(F.nullif(F.size("b"), F.lit(0))), 6).alias("score"))


@query(
    "reading_ease",
    f"WITH x AS (SELECT doc_id, text AS s, {sql_words('text')} AS all_words FROM documents WHERE text IS NOT NULL), "
    f"y AS (SELECT doc_id, all_words, {sql_words('s')} AS w, greatest(1, len(regexp_extract_all(s, '[.!?]+'))) AS n, "
    "len(regexp_extract_all(lower(s), '[aeiouyäöü]+')) AS v FROM x) SELECT doc_id, round(greatest(0, least(100, 206.835 - 1.015 * w / n::double - 84.6 * greatest(w, v) / w::double)), 6) "
    "AS ease FROM y WHERE all_words > 30",
)
def reading_ease(spark: SparkSession, folder: str) -> DataFrame:
    scored = _documents(spark, folder).select("doc_id", F.round(T.reading_ease(F.col("text")), 6).alias("ease"))
    return scored.where("ease is not null")


@query(
    "passage_split",
    f"WITH x AS (SELECT doc_id, text, string_split_regex(regexp_replace(text, '([.!?]){_S}', '\\1' || chr(1), 'g'), chr(1) || '|\\n+') AS p FROM documents WHERE text IS NOT NULL), "
    f"y AS (SELECT doc_id, list_filter(list_transform(p, lambda q: trim(q, ' ')), lambda q: {sql_words('q')} >= 5) AS p FROM x) SELECT doc_id, CAST(greatest(1, len(p)) AS INTEGER) AS n FROM y",
)
def passage_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).where("text is not null")
    return rows.select("doc_id", F.size(T.passages(F.col("text"))).alias("n"))


_LEFT = "SELECT aio_sentence AS text, min(match_id) AS match_id FROM passage_matches_ngram WHERE aio_sentence IS NOT NULL GROUP BY aio_sentence"
_RIGHT = "SELECT source_sentence AS text, min(match_id) AS source_id FROM passage_matches_ngram WHERE source_sentence IS NOT NULL GROUP BY source_sentence"


@query(
    "ngram_reuse_pairs",
    f"WITH l AS (SELECT match_id, unnest({sql_ngrams('t', 8)}) AS g FROM (SELECT match_id, {sql_tokens('text')} AS t FROM ({_LEFT}))), "
    f"r AS (SELECT source_id, unnest({sql_ngrams('t', 8)}) AS g FROM (SELECT source_id, {sql_tokens('text')} AS t FROM ({_RIGHT}))) "
    "SELECT match_id, source_id, count(*) AS shared FROM l JOIN r USING (g) GROUP BY match_id, source_id",
)
def ngram_reuse_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Answer and source sentences that share a run of 8 tokens; equal texts are one row each."""
    left = similarity.distinct_texts(_passages(spark, folder), "match_id", "aio_sentence")
    right = similarity.distinct_texts(
        _passages(spark, folder).withColumnRenamed("match_id", "source_id"), "source_id", "source_sentence"
    )
    return similarity.shared_ngrams(left, right, "match_id", "source_id", 8)


@query(
    "ngram_first_match",
    f"WITH l AS (SELECT match_id, unnest({sql_ngrams('t', 8)}) AS g FROM (SELECT match_id, {sql_tokens('text')} AS t FROM ({_LEFT}))), "
    f"r AS (SELECT source_id, unnest({sql_ngrams('t', 8)}) AS g FROM (SELECT source_id, {sql_tokens('text')} AS t FROM ({_RIGHT}))) "
    "SELECT match_id, min(source_id) AS source_id FROM l JOIN r USING (g) GROUP BY match_id",
)
def ngram_first_match(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.first_match(ngram_reuse_pairs(spark, folder), "match_id", ["source_id"]).select("match_id", "source_id")


@query(
    "longest_common_run",
    f"WITH x AS (SELECT match_id, {sql_tokens('aio_sentence')} AS a, {sql_tokens('source_sentence')} AS b FROM passage_matches_ngram WHERE aio_sentence IS NOT NULL AND source_sentence IS NOT NULL), "
    "p AS (SELECT match_id, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS i FROM x), q AS (SELECT match_id, unnest(b) AS w, unnest(range(1, len(b) + 1)) AS j FROM x), "
    "m AS (SELECT match_id, i, j - i AS d, i - row_number() OVER (PARTITION BY match_id, j - i ORDER BY i) AS island FROM p JOIN q USING (match_id, w)), "
    "r AS (SELECT match_id, max(n) AS run FROM (SELECT match_id, count(*) AS n FROM m GROUP BY match_id, d, island) GROUP BY match_id) "
    "SELECT x.match_id, CAST(coalesce(run, 0) AS INTEGER) AS run FROM x LEFT JOIN r ON x.match_id = r.match_id",
)
def longest_common_run(spark: SparkSession, folder: str) -> DataFrame:
    rows = _passages(spark, folder).where("aio_sentence is not null and source_sentence is not null")
    run = similarity.longest_common_run(T.tokens(F.col("aio_sentence")), T.tokens(F.col("source_sentence")))
    return rows.select("match_id", run.alias("run"))


def _sql_terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zäöüß0-9_]{{2,}}')"


def _terms(x: str) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-zäöüß0-9_]{2,}"), F.lit(0))


_TFIDF = f"""WITH x AS (SELECT match_id AS id, 0 AS side, query_id, {_sql_terms('aio_sentence')} AS t FROM passage_matches_ngram WHERE aio_sentence IS NOT NULL UNION ALL
 SELECT match_id, 1, query_id, {_sql_terms('source_sentence')} FROM passage_matches_ngram WHERE source_sentence IS NOT NULL),
 n AS (SELECT count(*) AS n FROM x), f AS (SELECT id, side, query_id, term, count(*) AS tf FROM (SELECT id, side, query_id, unnest(t) AS term FROM x) GROUP BY ALL),
 d AS (SELECT term, ln((1 + n) / (1 + count(*))::double) + 1 AS idf FROM f, n GROUP BY term, n),
 w AS (SELECT id, side, query_id, term, tf * idf AS w FROM f JOIN d USING (term)),
 l AS (SELECT id, side, sqrt(sum(w * w)) AS norm FROM w GROUP BY id, side), v AS (SELECT id, side, query_id, term, w / norm AS w FROM w JOIN l USING (id, side))"""


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    p = _passages(spark, folder)
    sides = [
        p.where(F.col(c).isNotNull()).select(F.col("match_id").alias("id"), F.lit(i).alias("side"), "query_id", _terms(c).alias("t"))
        for i, c in enumerate(("aio_sentence", "source_sentence"))
    ]
    return similarity.tfidf(sides[0].unionByName(sides[1]), ["id", "side", "query_id"], "t")


@query(
    "tfidf_cosine_pairs",
    _TFIDF + " SELECT a.id AS match_id, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.id = b.id AND a.term = b.term WHERE a.side = 0 AND b.side = 1 GROUP BY a.id",
)
def tfidf_cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each row's two sentences; rows without a common term have none."""
    v = stage(_weights(spark, folder), "tfidf-weights")
    a = v.where("side = 0").select("id", "term", F.col("w").alias("wa"))
    b = v.where("side = 1").select("id", "term", F.col("w").alias("wb"))
    dots = a.join(b, ["id", "term"]).groupBy(F.col("id").alias("match_id"))
    return dots.agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cosine"))


@query(
    "best_passage",
    _TFIDF + ", s AS (SELECT a.id AS match_id, b.id AS source_id, round(sum(a.w * b.w), 9) AS cosine FROM v a JOIN v b ON a.query_id = b.query_id AND a.term = b.term "
    "WHERE a.side = 0 AND b.side = 1 GROUP BY a.id, b.id) SELECT match_id, arg_max(source_id, struct_pack(c := cosine, i := -source_id)) AS source_id, round(max(cosine), 6) AS cosine FROM s "
    "WHERE cosine >= 0.45 GROUP BY match_id",
)
def best_passage(spark: SparkSession, folder: str) -> DataFrame:
    """The source sentence of the same query with the highest cosine of at least 0.45; ties go to the smallest id."""
    v = stage(_weights(spark, folder), "tfidf-weights")
    a = v.where("side = 0").select("query_id", "term", F.col("id").alias("match_id"), "w")
    b = v.where("side = 1").select("query_id", "term", F.col("id").alias("source_id"), "w")
    pairs = similarity.cosine_join(a, b, "match_id", "source_id", ["query_id"], 0.45)
    return pairs.groupBy("match_id").agg(
        F.max_by("source_id", F.struct("cosine", -F.col("source_id"))).alias("source_id"), F.round(F.max("cosine"), 6).alias("cosine")
    )


@query(
    "embedding_cosine_topk",
    "WITH s AS (SELECT q.vec_id AS query, e.vec_id AS vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity "
    "FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) SELECT query, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC) <= 5",
)
def embedding_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest cosines of each query vector; the queries are the rows whose id is divisible by 100."""
    e = table(spark, folder, "embeddings")
    near = similarity.nearest_vectors(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), 5)
    return near.select("query", F.round("similarity", 6).alias("similarity"))


@query(
    "group_concat_top_queries",
    "SELECT lang, string_agg(kind || ':' || n, ' | ' ORDER BY n DESC, kind) AS kinds FROM (SELECT lang, kind, count(*) AS n FROM documents WHERE lang IS NOT NULL AND kind IS NOT NULL GROUP BY lang, kind "
    "QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, kind) <= 3) GROUP BY lang",
)
def group_concat_top_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent kinds of each language, in one string."""
    from citelens.operators.relational import top_k

    counts = _documents(spark, folder).where("lang is not null and kind is not null").groupBy("lang", "kind").agg(F.count("*").alias("n"))
    first = top_k(counts, ["lang"], [F.desc("n"), F.col("kind")], 3)
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("position").alias("p"), F.concat("kind", F.lit(":"), F.col("n").cast("string")).alias("k")))),
        lambda x: x["k"],
    )
    return first.groupBy("lang").agg(F.array_join(listed, " | ").alias("kinds"))


# Transcripts: lines "m:ss text" of documents of that kind.
_SNIPPET = r"^(\d+):(\d\d) (.*)$"


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, snippets array<struct<start, text>>) of the transcripts; lines without a time are left out."""
    rows = _documents(spark, folder).where("kind = 'transcript' and text is not null")
    snippets = F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(_SNIPPET))),
        lambda x: F.struct(
            (F.regexp_extract(x, _SNIPPET, 1).cast("double") * 60 + F.regexp_extract(x, _SNIPPET, 2).cast("double")).alias("start"),
            F.regexp_extract(x, _SNIPPET, 3).alias("text"),
        ),
    )
    return rows.select("doc_id", snippets.alias("snippets")).where(F.size("snippets") > 0)


_SNIPPETS_SQL = """WITH x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^(\\d+):(\\d\\d) (.*)$')) AS ls FROM documents WHERE kind = 'transcript' AND text IS NOT NULL),
 s AS (SELECT doc_id, i, CAST(regexp_extract(ls[i], '^(\\d+):(\\d\\d) (.*)$', 1) AS DOUBLE) * 60 + CAST(regexp_extract(ls[i], '^(\\d+):(\\d\\d) (.*)$', 2) AS DOUBLE) AS t,
 regexp_extract(ls[i], '^(\\d+):(\\d\\d) (.*)$', 3) AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM x))"""


@query(
    "transcript_tumbling",
    # a window ends with the first snippet that begins 30 s or more after it, and the next begins at that time
    _SNIPPETS_SQL + ", r AS (SELECT * FROM (WITH RECURSIVE q AS (SELECT doc_id, i, t, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, "
    "first_value(t) OVER (PARTITION BY doc_id ORDER BY i) AS t0 FROM s), z AS (SELECT doc_id, n, t0 AS since, t, text FROM q WHERE n = 1 UNION ALL "
    "SELECT q.doc_id, q.n, CASE WHEN z.t - z.since >= 30 THEN z.t ELSE z.since END, q.t, q.text FROM z JOIN q ON q.doc_id = z.doc_id AND q.n = z.n + 1) SELECT * FROM z)), "
    "k AS (SELECT doc_id, n, since, text, sum(c) OVER (PARTITION BY doc_id ORDER BY n) AS w FROM (SELECT *, CASE WHEN n = 1 THEN 0 WHEN lag(t) OVER p - lag(since) OVER p >= 30 THEN 1 ELSE 0 END AS c FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY n))) "
    "SELECT doc_id, any_value(since) AS start, CAST(length(string_agg(text, ' ' ORDER BY n)) AS INTEGER) AS n_chars FROM k GROUP BY doc_id, w",
)
def transcript_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 30 s that begin with the data."""
    w = transcripts(spark, folder).select("doc_id", F.inline(windows.tumbling_windows(F.col("snippets"), 30.0)))
    return w.select("doc_id", "start", F.length("text").alias("n_chars"))


@query(
    "transcript_tumbling_grid",
    _SNIPPETS_SQL + " SELECT doc_id, floor(t / 30) * 30 AS start, count(*) AS snippets, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM s GROUP BY doc_id, floor(t / 30)",
)
def transcript_tumbling_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 30 s on a fixed grid."""
    each = transcripts(spark, folder).select("doc_id", F.inline("snippets"))
    return each.groupBy("doc_id", (F.floor(F.col("start") / 30) * 30).cast("double").alias("start")).agg(
        F.count("*").alias("snippets"), F.sum(F.length("text")).alias("n_chars")
    )


@query(
    "transcript_sliding",
    _SNIPPETS_SQL + ", w AS (SELECT doc_id, i, text, t, unnest(range(CAST(greatest(0, floor((t - 45) / 15) + 1) AS BIGINT), CAST(floor(t / 15) AS BIGINT) + 1)) AS k FROM s) "
    "SELECT doc_id, CAST(k * 15 AS DOUBLE) AS start, string_agg(text, ' ' ORDER BY i) AS text FROM w GROUP BY doc_id, k HAVING trim(string_agg(text, ' ' ORDER BY i), ' ') <> ''",
)
def transcript_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return windows.sliding_windows(transcripts(spark, folder), "doc_id", "snippets", 45.0, 15.0).withColumn(
        "start", F.col("start").cast("double")
    )


@query(
    "best_window_gap",
    _SNIPPETS_SQL + ", w0 AS (SELECT doc_id, i, text, t, unnest(range(CAST(greatest(0, floor((t - 45) / 15) + 1) AS BIGINT), CAST(floor(t / 15) AS BIGINT) + 1)) AS k FROM s), "
    "w AS (SELECT doc_id, k * 15.0::double AS start, string_agg(text, ' ' ORDER BY i) AS text FROM w0 GROUP BY doc_id, k HAVING trim(string_agg(text, ' ' ORDER BY i), ' ') <> ''), "
    "f AS (SELECT query_id, arg_min(aio_sentence, match_id) AS s FROM passage_matches_ngram WHERE aio_sentence IS NOT NULL GROUP BY query_id), "
    f"k AS (SELECT d.doc_id, {_content_sql('f.s')} AS words FROM documents d JOIN f ON f.query_id = d.query_id WHERE d.kind = 'transcript'), "
    f"c AS (SELECT w.doc_id, start, words, {_content_sql('text')} AS own FROM w JOIN k ON k.doc_id = w.doc_id), "
    "v AS (SELECT doc_id, start, CASE WHEN len(list_intersect(own, words)) > 0 THEN round(len(list_intersect(own, words)) / sqrt(len(own)), 12) ELSE 0 END AS v FROM c) "
    "SELECT doc_id, CASE WHEN max(v) > 0 THEN arg_max(start, struct_pack(a := v, b := -start)) ELSE 0 END AS best_start, max(v) AS score FROM v GROUP BY doc_id",
)
def best_window_gap(spark: SparkSession, folder: str) -> DataFrame:
    """The best window of each transcript for its query's first answer sentence."""
    t = transcripts(spark, folder).join(_documents(spark, folder).select("doc_id", "query_id"), "doc_id")
    answers = _passages(spark, folder).where("aio_sentence is not null").groupBy("query_id").agg(F.min_by("aio_sentence", "match_id").alias("s"))
    target = t.select("doc_id", "query_id").join(answers, "query_id").select("doc_id", T.content_words(F.col("s")).alias("words"))
    wins = windows.sliding_windows(t, "doc_id", "snippets")
    return windows.best_window(wins, "doc_id", target, "words")


@query(
    "event_tumbling",
    "SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def event_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    w = F.window("ts", "1 hour")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


@query(
    "event_sliding",
    "SELECT to_timestamp(k * 900)::TIMESTAMP AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest(range(CAST(floor(epoch(ts) / 900) AS BIGINT) - 2, "
    "CAST(floor(epoch(ts) / 900) AS BIGINT) + 1)) AS k FROM events) GROUP BY k",
)
def event_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 45 minutes every 15 minutes."""
    e = table(spark, folder, "events")
    return e.groupBy(F.window("ts", "45 minutes", "15 minutes").alias("w")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users")
    ).select(F.col("w.start").alias("start"), "n", "users")


@query(
    "json_props",
    "SELECT event_type, count(*) AS n, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS total_k FROM (SELECT event_type, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY event_type",
)
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    e = table(spark, folder, "events").select("event_type", k.alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.sum("k").alias("total_k"))


@query(
    "stratified_sample",
    "SELECT doc_id, kind FROM documents WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) <= 20",
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty documents of each kind, in the order of a hash: a sampling operator."""
    from citelens.operators.validation import stratified_sample as sample

    return sample(_documents(spark, folder).where("kind is not null"), "kind", "doc_id", 20, "42").select("doc_id", "kind")


@query(
    "label_agreement",
    "SELECT is_ranked, count(*) AS n, count(agrees) AS checked, round(avg(CAST(agrees AS INTEGER)), 6) AS agreement, CASE WHEN count_if(NOT agrees) = 0 THEN round(3.0 / nullif(count(agrees), 0), 6) END AS bound "
    "FROM label_validation GROUP BY is_ranked",
)
def label_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of checked labels, with the rule of three where none disagrees."""
    from citelens.functions.stats import rule_of_three

    each = table(spark, folder, "label_validation").groupBy("is_ranked").agg(
        F.count("*").alias("n"),
        F.count("agrees").alias("checked"),
        F.round(F.avg(F.col("agrees").cast("int")), 6).alias("agreement"),
        F.count_if(~F.col("agrees")).alias("against"),
    )
    bound = F.when(F.col("against") == 0, F.round(rule_of_three(F.col("checked")), 6)).alias("bound")
    return each.select("is_ranked", "n", "checked", "agreement", bound)
