"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import codepoint2name

from pyspark.sql import DataFrame, SparkSession

from citelens.llm import copies, encoding_repair, group_split, main_text, packing, shared_spans, site_lines, tokenize

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_lines(_table(spark, folder, "page_content")).select("page_id", "line")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.without_repeated_lines(_table(spark, folder, "page_content"))


def p1_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.block_table(_table(spark, folder, "page_content"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(_table(spark, folder, "candidates"), _table(spark, folder, "label_validation"))


def p3_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapsed(_table(spark, folder, "candidates"), _table(spark, folder, "label_validation"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.tied_sets(_table(spark, folder, "label_validation")).select("row_id", "set_domain")


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.grouped_splits(
        _table(spark, folder, "label_validation"), _table(spark, folder, "split_shares")
    )


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.split_report(_table(spark, folder, "label_validation"), _table(spark, folder, "split_shares"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.body_lines(_table(spark, folder, "page_content"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_pairs(
        _table(spark, folder, "passage_matches_ngram"), _table(spark, folder, "page_content")
    )


def p6_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_sizes(
        _table(spark, folder, "passage_matches_ngram"), _table(spark, folder, "page_content")
    )


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encoded(_table(spark, folder, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.round_trip(_table(spark, folder, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(_table(spark, folder, "documents"), _table(spark, folder, "container_limits"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(_table(spark, folder, "documents"), _table(spark, folder, "container_limits"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.garbled_documents(_table(spark, folder, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.restored_documents(_table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


#: Site of a url as citelens.functions.site has it.
_SITE = (
    "nullif(regexp_replace(regexp_replace(trim(lower(coalesce("
    "nullif(regexp_extract(url, '(?i)(?:[a-z][a-z0-9+.\\-]*:)?//(?:[^/?#\\s@]*@)?([^/?#\\s:)>\\]\"''\\\\]+)', 1), ''), "
    "regexp_extract(url, '^[\\s \"''<(\\[]*([^/?#\\s:)>\\]\"''\\\\ ]+\\.[^/?#\\s:)>\\]\"''\\\\ ]+)', 1))), ' '), '[.,;]+$', ''), '^www\\.', ''), '')"
)


# Copies as SQL: what may stand around a url, the url's parts, and windows over equal parts.
_OPEN = "[\\s\\p{Z}<(\"''„“‚‘«‹›`\\[]"
_CLOSE = "[\\s\\p{Z}>\"''“”‘’«»‹›`\\].,;:!?…]"
_CORE = f"regexp_replace(regexp_replace(CASE WHEN regexp_matches(url, '\\]\\s*\\(') THEN regexp_extract(url, '(?s).*\\]\\s*\\((.*)\\)', 1) ELSE url END, '^{_OPEN}+', ''), '(?:{_CLOSE}|/)+$', '')"
# a closing bracket that was never opened, and what stands before it
_UNOPENED = f"CASE WHEN ends_with(u, ')') AND length(u) - length(replace(u, ')', '')) > length(u) - length(replace(u, '(', '')) THEN regexp_replace(regexp_replace(u, '\\)+$', ''), '(?:{_CLOSE}|/)+$', '') ELSE u END"
_CLASSES = f"""WITH a AS (
 SELECT 'candidates' AS table_name, row_id, query_id, query, url, CAST(organic_rank AS VARCHAR) AS rest FROM candidates UNION ALL
 SELECT 'label_validation', row_id, query_id, query, url, concat(coalesce(CAST(is_ranked AS VARCHAR), '-'), '|', coalesce(CAST(label AS VARCHAR), '-'), '|', coalesce(CAST(expected AS VARCHAR), '-')) FROM label_validation),
 b AS (SELECT * EXCLUDE (url, query), array_to_string(regexp_extract_all(nfc_normalize(lower(query)), '[\\p{{L}}\\p{{N}}]+'), ' ') AS words, {_CORE} AS u FROM a WHERE query_id IS NOT NULL AND url <> ''),
 c AS (SELECT * EXCLUDE (u), regexp_replace({_UNOPENED}, '^(?i)(?:[a-z][a-z0-9+.\\-]*:)?//', '') AS u FROM b),
 d AS (SELECT * EXCLUDE (u), split_part(u, '#', 1) AS u, CASE WHEN contains(u, '#') THEN regexp_replace(u, '^[^#]*', '') ELSE '' END AS fragment FROM c),
 e AS (SELECT *, split_part(u, '?', 1) AS address, CASE WHEN contains(u, '?') THEN regexp_replace(u, '^[^?]*\\?', '') ELSE '' END AS parameters FROM d),
 f AS (SELECT table_name, row_id, query_id, words, rest, fragment, regexp_replace(lower(split_part(address, '/', 1)), '^www\\.', '') AS host,
  list_filter(string_split(url_decode(CASE WHEN contains(address, '/') THEN regexp_replace(address, '^[^/]*', '') ELSE '' END), '/'), lambda x: x <> '') AS path,
  list_sort(list_transform(list_filter(string_split(parameters, '&'), lambda x: x <> ''), lambda x: url_decode(x))) AS names FROM e),
 g AS (SELECT table_name, row_id, min(row_id) OVER (PARTITION BY table_name, query_id, words, rest, host, path, names, fragment) AS first_id FROM f WHERE host <> '' OR len(path) > 0 OR len(names) > 0)"""


# Lines of a page as SQL: what is hidden goes, inline tags vanish, all others end a line, and entities of these signs are decoded.
_SIGNS = "äöüÄÖÜß€²„“”–\u00a0"
_ATTRIBUTES = """(?:[^>"'']|"[^"]*"|''[^'']*'')*(?:>|\\z)"""


def _decoded(text: str) -> str:
    for c in _SIGNS:
        for form in (f"&{codepoint2name[ord(c)]};", f"&#{ord(c)};", f"&#x{ord(c):X};"):
            text = f"replace({text}, '{form}', chr({ord(c)}))"
    return f"replace({text}, '&amp;', '&')"


def _without(text: str, pattern: str, put: str = "<br>") -> str:
    return f"regexp_replace({text}, '{pattern}', '{put}', 'gis')"


def _lines_sql(lower: bool = True) -> str:
    """The lines of html, each once, in no order."""
    return f"list_distinct({_all_lines_sql(lower)})"


def _all_lines_sql(lower: bool = True) -> str:
    text = _without("html", r"<!--.*?(?:-->|\z)", "")
    for tag in ("script", "style", "noscript"):
        text = _without(text, rf"<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)")
    text = _without(text, r"<head\b[^>]*>.*?(?:</head\s*>|(<body\b)|\z)", r"<br>\1")
    text = _without(text, rf"</?(?:a|b|strong|em|i|span|u)(?:>|\z|[\s/]{_ATTRIBUTES})", "")
    text = _without(text, rf"<[/!?]?[a-z]{_ATTRIBUTES}|<[!?/][^>]*(?:>|\z)", "\x01")
    part = r"regexp_replace(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')"
    part = f"lower({part})" if lower else part
    return f"list_filter(list_transform(string_split({_decoded(text)}, '\x01'), lambda x: {part}), lambda x: x <> '')"


_FREQUENT = (
    f"WITH l AS (SELECT page_id, {_SITE} AS site, {_all_lines_sql()} AS lines FROM page_content), "
    "n AS (SELECT site, count(*) AS pages FROM l WHERE len(lines) > 0 AND site IS NOT NULL GROUP BY site), x AS (SELECT page_id, site, unnest(list_distinct(lines)) AS line FROM l WHERE site IS NOT NULL), "
    "k AS (SELECT site, line FROM x JOIN n USING (site) GROUP BY site, line, pages HAVING count(*) >= 5 AND count(*) >= 0.25 * pages)"
)
_CLEAN = (
    _FREQUENT + ", o AS (SELECT page_id, site, list_filter(coalesce(lines, []), lambda y, i: list_position(lines, y) = i) AS lines FROM l), s AS (SELECT site, list(line) AS known FROM k GROUP BY site) "
    "SELECT page_id, CAST(len(list_filter(lines, lambda y: list_contains(coalesce(known, []), y))) AS INTEGER) AS removed, "
    "array_to_string(list_filter(lines, lambda y: NOT list_contains(coalesce(known, []), y)), chr(10)) AS text FROM o LEFT JOIN s ON o.site = s.site"
)
_LEAST = shared_spans.LEAST
_WINDOWS = f"unnest(list_transform(range(1, length(t) - {_LEAST - 2}), lambda i: substr(t, i, {_LEAST}))) AS w"
_SHARED = (
    "WITH s AS (SELECT match_id, regexp_replace(unnest([aio_sentence, source_sentence]), '[\\s\\p{Z}]+', ' ', 'g') AS t FROM passage_matches_ngram), "
    f"a AS (SELECT DISTINCT match_id, {_WINDOWS} FROM s WHERE length(t) >= {_LEAST}), "
    f"l AS (SELECT page_id, unnest({_lines_sql(False)}) AS t FROM page_content WHERE length(html) > 0), "
    f"b AS (SELECT page_id, {_WINDOWS} FROM l WHERE length(t) >= {_LEAST}) SELECT DISTINCT match_id, page_id FROM b JOIN a USING (w)"
)


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it on whole tables; the other operators are tested against plain loops and round trips."""
    return {
        "p1_found": _FREQUENT + " SELECT page_id, line FROM x JOIN k USING (site, line)",
        "p1_clean": _CLEAN,
        "p6_found": _SHARED,
        "p3_found": _CLASSES + " SELECT table_name, first_id, row_id AS copy_id FROM g WHERE row_id <> first_id",
        "p3_collapsed": _CLASSES
        + " SELECT table_name, first_id AS row_id, count(*) AS copies FROM g GROUP BY ALL UNION ALL SELECT table_name, row_id, 1 FROM a "
        "WHERE NOT EXISTS (FROM g WHERE g.table_name = a.table_name AND g.row_id = a.row_id)",
        "p4_found": f"""WITH RECURSIVE r AS (SELECT row_id, query_id, {_SITE} AS site FROM label_validation),
 e AS (SELECT DISTINCT query_id, site FROM r WHERE query_id IS NOT NULL AND site IS NOT NULL),
 n AS (SELECT DISTINCT a.site AS a, b.site AS b FROM e a JOIN e b ON a.query_id = b.query_id),
 reach(a, b) AS (SELECT DISTINCT site, site FROM r WHERE site IS NOT NULL UNION SELECT reach.a, n.b FROM reach JOIN n ON reach.b = n.a),
 least AS (SELECT a AS site, min(b) AS first FROM reach GROUP BY a),
 q AS (SELECT query_id, min(first) AS first FROM e JOIN least USING (site) GROUP BY query_id)
 SELECT row_id, coalesce(l.first, q.first) AS set_domain FROM r LEFT JOIN least l ON r.site = l.site LEFT JOIN q ON r.query_id = q.query_id"""
    }
