"""Page features from HTML: one pass of the standard parser over each page, in Arrow batches."""

from __future__ import annotations

import json
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelens.functions import text as text_functions
from citelens.functions import url as url_functions

_SILENT = frozenset(("script", "style", "noscript"))
_DATES = ("article:modified_time", "article:published_time")

PARSED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("json_ld", T.ArrayType(T.StringType())),
        T.StructField("schema_types", T.ArrayType(T.StringType())),
        T.StructField("has_itemtype", T.BooleanType()),
        T.StructField("has_details", T.BooleanType()),
        T.StructField("has_video", T.BooleanType()),
        T.StructField("lists_tables", T.IntegerType()),
        T.StructField("dates", T.ArrayType(T.StringType())),
        T.StructField("first_list_pos", T.DoubleType()),
        T.StructField("first_table_pos", T.DoubleType()),
        T.StructField("first_heading_pos", T.DoubleType()),
        T.StructField("first_paragraph_words", T.IntegerType()),
    ]
)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.scripts: list[list[str]] = []
        self.silent = self.in_title = 0
        self.ld: list[str] | None = None
        self.itemtype = self.details = self.video = False
        self.lists = 0
        self.meta: dict[str, str] = {}
        self.time: str | None = None
        self.at: dict[str, int] = {}
        self.length = 0
        self.paragraph: list[str] | None = None
        self.first_words: int | None = None

    def _end_paragraph(self) -> None:
        if self.paragraph is not None and self.first_words is None:
            n = len("".join(self.paragraph).split())
            if n >= 10:
                self.first_words = n
        self.paragraph = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        self.itemtype = self.itemtype or "itemtype" in named
        if tag in _SILENT:
            self.silent += 1
            if tag == "script" and (named.get("type") or "").lower() == "application/ld+json":
                self.ld = []
        elif tag == "title" and not self.title:
            self.in_title += 1
        elif tag in ("ul", "ol", "table"):
            self.lists += 1
            self.at.setdefault("table" if tag == "table" else "list", self.length)
            self._end_paragraph()
        elif tag in ("h2", "h3"):
            self.at.setdefault("heading", self.length)
            self._end_paragraph()
        elif tag == "p":
            self._end_paragraph()
            self.paragraph = []
        elif tag == "meta" and named.get("property") in _DATES and named.get("content"):
            self.meta.setdefault(named["property"], named["content"])
        elif tag == "time" and self.time is None and named.get("datetime"):
            self.time = named["datetime"]
        self.details = self.details or tag == "details"
        self.video = self.video or tag == "video"

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            if self.ld is not None:
                self.scripts.append(self.ld)
                self.ld = None
        elif tag == "title":
            self.in_title = max(0, self.in_title - 1)
        elif tag in ("p", "div", "section", "article", "td", "li", "body"):
            self._end_paragraph()

    def handle_data(self, data: str) -> None:
        if self.ld is not None:
            self.ld.append(data)
        if self.silent:
            return
        if self.in_title:
            self.title.append(data)
        self.parts.append(data)
        self.length += len(data)
        if self.paragraph is not None:
            self.paragraph.append(data)


def _blocks(scripts: list[list[str]]) -> list[dict]:
    """JSON-LD objects; an @graph stands for its members, a list for its objects; bad JSON is skipped."""
    out: list[dict] = []
    for script in scripts:
        try:
            data = json.loads("".join(script))
        except ValueError:
            continue
        found = data.get("@graph", [data]) if isinstance(data, dict) else data if isinstance(data, list) else []
        out += [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
    return out


def parse_page(html: str | None) -> tuple | None:
    """The fields of PARSED; None for a null page."""
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._end_paragraph()
    if reader.ld is not None:
        reader.scripts.append(reader.ld)
    blocks = _blocks(reader.scripts)
    types: list[str] = []
    for b in blocks:
        t = b.get("@type")
        types += map(str, t) if isinstance(t, list) else [str(t)] if t else []
    dates = [str(b[k]) for b in blocks for k in ("dateModified", "datePublished") if b.get(k)]
    dates += [reader.meta[k] for k in _DATES if k in reader.meta]
    dates += [reader.time] if reader.time else []
    total = max(1, reader.length + max(0, len(reader.parts) - 1))
    place = {k: round(v / total, 3) for k, v in reader.at.items()}
    return (
        " ".join(" ".join(reader.parts).split()),
        " ".join("".join(reader.title).split()),
        [json.dumps(b, ensure_ascii=False) for b in blocks],
        list(dict.fromkeys(types)),
        reader.itemtype,
        reader.details,
        reader.video,
        reader.lists,
        dates,
        place.get("list"),
        place.get("table"),
        place.get("heading"),
        reader.first_words,
    )


@F.pandas_udf(PARSED)
def parsed_page(html):
    import pandas as pd

    blank = (None,) * len(PARSED)
    return pd.DataFrame([parse_page(x) or blank for x in html], columns=PARSED.names)


def tag_count(html: Column, *names: str) -> Column:
    """How often elements of these names begin, outside of comments, scripts and styles."""
    shown = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    return F.regexp_count(shown, F.lit(rf"(?i)<(?:{'|'.join(names)})(?=[\s/>])"))


def freshness_days(dates: Column, as_of: str) -> Column:
    """Days from the first date that parses and doesn't lie after ``as_of``; NULL without one."""
    ref = F.lit(as_of).cast("timestamp")
    days = F.transform(dates, lambda d: F.floor((ref.cast("double") - F.try_to_timestamp(d).cast("double")) / 86400))
    return F.get(F.filter(days, lambda n: n >= 0), 0)


def onpage_features(pages: DataFrame, as_of: str, *keep: str) -> DataFrame:
    """``keep``, the page's features and its text. ``pages`` has url, html and ok.

    A failed crawl has NULL features and the neutral content type; what the url alone tells is still there.
    """
    good = F.col("ok") & (F.length("html") > 0)
    p = pages.select(*keep, "url", parsed_page(F.when(good, F.col("html"))).alias("p"))
    alive = F.col("p.text").isNotNull()
    low = F.lower("p.text")
    types = F.col("p.schema_types")
    faq = F.array_contains(types, "FAQPage") | F.col("p.has_details")
    faq = faq | F.contains(low, F.lit("frequently asked")) | F.contains(low, F.lit("häufige fragen"))
    guess = url_functions.content_type(F.col("url"), F.col("p.title"), F.array_contains(types, "Product"))
    video = F.array_contains(types, "VideoObject") | F.col("p.has_video")
    return p.select(
        *keep,
        F.when(alive, text_functions.word_count(F.col("p.text"))).alias("word_count"),
        F.when(alive, (F.size("p.json_ld") > 0) | F.col("p.has_itemtype")).cast("int").alias("has_schema"),
        F.when(alive, faq).cast("int").alias("has_faq"),
        F.when(alive, F.least("p.lists_tables", F.lit(50))).alias("num_lists_tables"),
        text_functions.reading_ease(F.col("p.text")).alias("readability_score"),
        freshness_days(F.col("p.dates"), as_of).alias("content_freshness_days"),
        url_functions.is_https(F.col("url")).alias("is_https"),
        url_functions.is_forum(F.col("url")).alias("is_forum"),
        (F.coalesce(video, F.lit(False)) | (url_functions.is_video_host(F.col("url")) == 1)).cast("int").alias("is_video"),
        F.when(alive, guess).otherwise("informational").alias("content_type"),
        F.col("p.title").alias("title"),
        F.col("p.text").alias("page_text"),
    )


def positions(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and where the first list, table and heading stand in the text, with the first long paragraph's words."""
    p = pages.select(*keep, parsed_page("html").alias("p")).where("p.text is not null")
    return p.select(
        *keep,
        "p.first_list_pos",
        "p.first_table_pos",
        "p.first_heading_pos",
        "p.first_paragraph_words",
        F.col("p.first_list_pos").isNotNull().cast("int").alias("has_any_list"),
        F.col("p.first_table_pos").isNotNull().cast("int").alias("has_any_table"),
    )
