"""Functions on texts, as columns that Catalyst sees through."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as both SQL engines and Python agree on it.
SPACE = r"[ \t\n\x0B\f\r]+"
WORD_PATTERN = "[a-zäöüßA-ZÄÖÜ0-9€%.,-]+"

# Cues of a definition and of an enumeration.
DEFINITION_CUES = (
    " ist ein", " ist eine", " ist der", " ist die", " ist das", " bedeutet", " bezeichnet", " versteht man", " definiert",
)
LIST_CUES = ("erstens", "zweitens", "folgende", "zum einen", "zum anderen", ":")
# German stop words of the content-word overlap.
STOP_WORDS = (
    "der die das und ist ich für wie was wo ein eine einen einem einer man kann sich auf mit von zu im in den dem des es am "
    "an bei wird werden sind hat haben oder auch als nach aus um so dann aber wenn dass sie wir er nicht noch nur sehr schon "
    "mehr bis vor über unter durch zum zur diese dieser dieses da hier also ja mal"
).split()
# German stop words of the question themes.
QUESTION_STOP_WORDS = (
    "der die das und ist ich für fur wie was wo wann warum welche welcher welches ein eine einen mein meine meiner man kann "
    "muss sich auf mit von zu im in den dem des es am an bei wird werden sind hat haben oder auch als nach bis aus um so "
    "wieviel viel gibt"
).split()


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


# Patterns of markdown and what stands for them, in the order of their use.
MARKDOWN = (
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\*\*([^*]*)\*\*", "$1"),
    (r"\*([^*]*)\*", "$1"),
    (r"\[+\d*\]+", " "),
    (r"\(https?://[^)]*\)", " "),
    (r"https?://[^ \t\n\x0B\f\r]+", " "),
)
# Patterns of traits.
CURRENCY, FORMULA = r"(euro|€|\beur\b)", r"=|×|\*|\+"


def clean_markdown(text: Column) -> Column:
    """Links become their labels; bold, italic, reference marks and urls go; white space is collapsed."""
    for pattern, replacement in MARKDOWN:
        text = F.regexp_replace(text, pattern, replacement)
    return collapse_space(text)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column, least: int = 6) -> Column:
    """Split after . ! ? and white space; trimmed; those of at least ``least`` words."""
    parts = F.transform(F.split(text, r"(?<=[.!?])" + SPACE), lambda x: F.trim(x))
    return F.filter(parts, lambda x: word_count(x) >= least)


def passages(text: Column, least: int = 5, most: int | None = None) -> Column:
    """Split at sentence ends or line ends; those of at least ``least`` words, all or the first ``most``; else the text itself."""
    parts = F.transform(F.split(text, r"(?<=[.!?])" + SPACE + r"|\n+"), lambda x: F.trim(x))
    parts = F.filter(parts, lambda x: word_count(x) >= least)
    parts = parts if most is None else F.slice(parts, 1, most)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def tokens(text: Column) -> Column:
    """Lower-case tokens; . , - % € stay within them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def content_words(text: Column) -> Column:
    """Distinct words of three or more letters or digits that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zäöüßA-ZÄÖÜ0-9]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def ngrams(items: Column, n: int) -> Column:
    """Distinct runs of n items joined by spaces; none if there are fewer."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.array_join(F.slice(items, i, F.lit(n)), " ")
    )
    return F.when(F.size(items) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _contains_any(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(cues[0]))
    for c in cues[1:]:
        out = out | F.contains(text, F.lit(c))
    return out.cast("int")


def traits(sentence: Column) -> dict[str, Column]:
    """Measurable traits of a sentence, by name."""
    low = F.lower(sentence)
    first = F.left(sentence, F.lit(1))
    return {
        "n_words": word_count(sentence),
        "has_number": F.rlike(sentence, F.lit("[0-9]")).cast("int"),
        "has_currency": F.rlike(low, F.lit(CURRENCY)).cast("int"),
        "has_percent": (F.contains(sentence, F.lit("%")) | F.contains(low, F.lit("prozent"))).cast("int"),
        "has_formula": F.rlike(sentence, F.lit(FORMULA)).cast("int"),
        "has_definition_cue": _contains_any(low, DEFINITION_CUES),
        "has_list_cue": _contains_any(low, LIST_CUES),
        "starts_capital": ((F.upper(first) == first) & (F.lower(first) != first)).cast("int"),
    }


def entity_overlap(query: Column, page: Column) -> Column:
    """Distinct words of four or more letters of the query that stand somewhere in the page."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-zäöüß]{4,}"), F.lit(0)))
    low = F.lower(page)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def reading_ease(text: Column, most: int | None = None) -> Column:
    """Flesch reading ease in [0, 100], of the text or its first ``most`` characters; NULL up to 30 words.

    A syllable is a vowel group.
    """
    start = text if most is None else F.left(text, F.lit(most))
    n_words = word_count(start)
    n_sentences = F.greatest(F.lit(1), F.regexp_count(start, F.lit(r"[.!?]+")))
    syllables = F.greatest(n_words, F.regexp_count(F.lower(start), F.lit("[aeiouyäöü]+")))
    score = 206.835 - 1.015 * n_words / n_sentences - 84.6 * syllables / n_words
    return F.when(word_count(text) > 30, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def text_or_else(df: DataFrame, text: str, otherwise: str, enough: int = 30, least: int = 10) -> DataFrame:
    """``df`` with body, page and n_words: ``text`` where it has ``enough`` words, else ``otherwise``; rows under ``least`` words go."""
    page = F.coalesce(word_count(F.col(text)) >= enough, F.lit(False))
    picked = df.withColumn("page", page).withColumn("body", F.when(F.col("page"), F.col(text)).otherwise(F.col(otherwise)))
    return picked.withColumn("n_words", word_count(F.col("body"))).where(F.col("n_words") >= least)


# English stop words of the similarity of a query and a page.
ENGLISH_STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can "
    "could did do does down during each few for from further had has have he her here him his how i if in into is it its me "
    "more most my no nor not of off on once only or other our out over own same she should so some such than that the their "
    "them then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with would you your"
).split()
_TERM = re.compile(r"\b\w\w+\b")
_SENTENCE_OR_LINE = re.compile(r"(?<=[.!?])\s+|\n+")
_SCORES = T.StructType([T.StructField("whole", T.DoubleType()), T.StructField("best", T.DoubleType())])


def _tfidf_scores(query: str, page: str, stop_words: frozenset[str], least: int) -> tuple[float, float]:
    parts = [p for x in _SENTENCE_OR_LINE.split(page) if len((p := x.strip()).split()) >= least] or [page]
    counted = [Counter(t for t in _TERM.findall(x.lower()) if t not in stop_words) for x in (query, page, *parts)]
    known = Counter(t for c in counted for t in c)
    idf = {t: math.log((1 + len(counted)) / (1 + n)) + 1 for t, n in known.items()}
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for c in counted]
    own = counted[0]

    def cosine(i: int) -> float:
        dot = sum(n * counted[i][t] * idf[t] ** 2 for t, n in own.items() if t in counted[i])
        return dot / (norms[0] * norms[i]) if dot else 0.0

    return cosine(1), max(map(cosine, range(2, len(counted))))


def query_similarity(query: Column, page: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS, least: int = 5) -> Column:
    """struct<whole, best>: TF-IDF cosine of the query with the page and with its best passage, within this page's own corpus.

    The corpus is the query, the page and its passages of ``least`` words or more; null or blank texts score 0.
    """
    stops = frozenset(stop_words)

    def run(queries: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = [_tfidf_scores(q, p, stops, least) if q and p and p.strip() else (0.0, 0.0) for q, p in zip(queries, pages)]
        return pd.DataFrame(rows, columns=["whole", "best"])

    return F.pandas_udf(run, _SCORES)(query, page)


def timecode_seconds(code: Column) -> Column:
    """HH:MM:SS.mmm, with a point or comma."""
    parts = F.split(F.replace(code, F.lit(","), F.lit(".")), ":")
    return parts[0].cast("double") * 3600 + parts[1].cast("double") * 60 + parts[2].cast("double")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, not below 0; NULL where one has length 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))

    return F.greatest(F.lit(0.0), dot / F.nullif(norm(a) * norm(b), F.lit(0.0)))
