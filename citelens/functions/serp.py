"""Functions on search responses: a typed view of the JSON, and what the tables take from it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelens.functions.url import clean_domain, clean_url
from citelens.operators import json_text
from citelens.schemas import REFERENCE, SENTINEL_RANK, SERP_FEATURES

# Numbers are read as strings, since responses write them either way, and cast where they are used.
_ITEM = (
    "struct<type:string,rank_group:string,rank_absolute:string,domain:string,title:string,description:string,url:string,"
    "markdown:string,position:string,asynchronous_ai_overview:string,"
    f"references:array<{REFERENCE}>,items:array<struct<type:string,title:string,text:string,references:array<{REFERENCE}>>>>"
)
RESPONSE = (
    "tasks array<struct<id:string,status_code:string,result:array<struct<keyword:string,type:string,item_types:array<string>,"
    f"se_results_count:string,items:array<{_ITEM}>>>>>"
)


def results(df: DataFrame, body: str) -> DataFrame:
    """``df`` with ``result``, the response's first result; rows without one (malformed, failed, empty) are left out.

    A body is parsed once: the generator keeps what is worked out from ``result`` from being pushed before it. Bodies beyond the
    JVM parser's limits (see ``operators.nested``) are left out too; ``rejected`` names them.
    """
    parsed = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, RESPONSE, {"mode": "PERMISSIVE"}))
    first = F.transform(F.array(parsed), lambda p: F.get(F.get(p["tasks"], 0)["result"], 0))
    kept = [c for c in df.columns if c != body]
    return df.select(*kept, F.explode(F.filter(first, lambda x: x.isNotNull())).alias("result"))


def rejected(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, reason) of the rows that ``results`` leaves out: no body, not JSON, beyond the parser's limits, or no result."""
    text = F.col(body)
    result = F.get(F.get(F.from_json(text, RESPONSE, {"mode": "PERMISSIVE"})["tasks"], 0)["result"], 0)
    parses = F.try_parse_json(text).isNotNull()
    reason = F.when(text.isNull(), "no body").when(~parses, "unread").when(result.isNull(), "no result")
    out = df.select(key, F.explode(F.filter(F.array(F.struct(reason.alias("reason"), text.alias("text"))), lambda x: x["reason"].isNotNull())).alias("x"))
    return out.select(key, F.when(F.col("x.reason") == "unread", _unread("x.text")).otherwise(F.col("x.reason")).alias("reason"))


@F.pandas_udf(T.StringType())
def _unread(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "not JSON" if t is None or json_text.parse(t) is None else "beyond the parser's limits")


def items(result: Column, kind: str | None = None) -> Column:
    own = F.coalesce(result["items"], F.array().cast(f"array<{_ITEM}>"))
    own = F.filter(own, lambda x: x.isNotNull())
    return own if kind is None else F.filter(own, lambda x: x["type"] == kind)


def feature_flags(result: Column, names: list[str] = SERP_FEATURES) -> dict[str, Column]:
    """1 for each result type that is among the items."""
    kinds = F.transform(items(result), lambda x: x["type"])
    return {f"has_{n}": F.coalesce(F.array_contains(kinds, n), F.lit(False)).cast("int") for n in names}


def references(result: Column) -> Column:
    """All references of all overviews: each one's own first, then those of its elements; copies stay."""
    empty = F.array().cast(f"array<{REFERENCE}>")

    def of(x: Column) -> Column:
        nested = F.flatten(F.transform(F.coalesce(x["items"], F.array()), lambda y: F.coalesce(y["references"], empty)))
        return F.concat(F.coalesce(x["references"], empty), F.coalesce(nested, empty))

    return F.filter(F.flatten(F.transform(items(result, "ai_overview"), of)), lambda r: r.isNotNull())


def overview_text(result: Column, first_only: bool = False) -> Column:
    """The overviews' markdown, then each element's text and title, by lines; trimmed."""
    own = items(result, "ai_overview")
    if first_only:
        own = F.slice(own, 1, 1)

    def of(x: Column) -> Column:
        parts = F.flatten(
            F.transform(F.coalesce(x["items"], F.array()), lambda y: F.array(F.nullif(y["text"], F.lit("")), F.nullif(y["title"], F.lit(""))))
        )
        return F.concat(F.array(F.nullif(x["markdown"], F.lit(""))), F.coalesce(parts, F.array()))

    lines = F.filter(F.flatten(F.transform(own, of)), lambda s: s.isNotNull())
    return F.trim(F.array_join(lines, "\n"))


def questions(result: Column) -> Column:
    """Titles of the questions people also ask."""
    own = F.flatten(F.transform(items(result, "people_also_ask"), lambda x: F.coalesce(x["items"], F.array())))
    return F.filter(F.transform(own, lambda y: y["title"]), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")


def query_facts(df: DataFrame) -> DataFrame:
    """``df`` (with result) with the counts and flags of query metadata."""
    r = F.col("result")
    overviews = items(r, "ai_overview")
    return df.select(
        *[c for c in df.columns if c != "result"],
        F.size(items(r, "organic")).alias("num_organic_results"),
        (F.size(overviews) > 0).cast("int").alias("ai_overview_present"),
        F.size(references(r)).alias("ai_overview_num_references"),
        F.exists(overviews, lambda x: F.coalesce(F.lower(x["asynchronous_ai_overview"]) == "true", F.lit(False))).cast("int").alias("ai_overview_is_async"),
        *[c.alias(n) for n, c in feature_flags(r).items()],
    )


def candidates(df: DataFrame, key: str, url_key: Callable[[Column], Column]) -> DataFrame:
    """(key, url, organic_rank, title, snippet, cited): organic results, then references that aren't among them.

    A page is cited if its url, by ``url_key``, is among the references. A reference outside the organic block has the
    sentinel rank. Within a response each url key stands once: the best rank, then the first position. Everything is worked out
    within the response's row, without a join.
    """
    r = F.col("result")
    organic = F.transform(
        items(r, "organic"),
        lambda x, i: F.struct(
            F.coalesce(x["rank_group"].try_cast("int"), F.lit(100)).alias("order"), i.alias("pos"), url_key(x["url"]).alias("k"), x["url"].alias("url"),
            x["rank_group"].try_cast("int").alias("organic_rank"), x["title"].alias("title"), x["description"].alias("snippet"),
        ),
    )
    cited = F.transform(references(r), lambda x, i: F.struct(clean_url(x["url"]).alias("url"), i.alias("pos"), x["title"].alias("title"), x["text"].alias("snippet")))
    cited = F.transform(
        F.filter(cited, lambda x: x["url"] != ""),
        lambda x: F.struct(
            F.lit(SENTINEL_RANK).alias("order"), x["pos"].alias("pos"), url_key(x["url"]).alias("k"), x["url"].alias("url"),
            F.lit(SENTINEL_RANK).alias("organic_rank"), x["title"].alias("title"), x["snippet"].alias("snippet"),
        ),
    )
    both = df.select(key, F.filter(organic, lambda x: x["url"].isNotNull()).alias("own"), cited.alias("cited"))
    keyed = both.select(key, "own", "cited", F.transform("cited", lambda x: x["k"]).alias("marks"), F.transform("own", lambda x: x["k"]).alias("known"))
    placed = keyed.select(
        key, "marks", F.sort_array(F.concat("own", F.filter("cited", lambda x: ~F.array_contains("known", x["k"])))).alias("all")
    )
    ordered = placed.select(key, "marks", "all", F.transform("all", lambda x: x["k"]).alias("ks"))
    best = F.filter("all", lambda x, i: F.array_position("ks", x["k"]) == i + 1)
    rows = ordered.select(key, "marks", F.explode(best).alias("c"))
    return rows.select(key, "c.url", "c.organic_rank", "c.title", "c.snippet", F.array_contains("marks", F.col("c.k")).cast("int").alias("cited"))


def citations(df: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(key, cited_url, cited_domain, cited_title, cited_snippet) of each reference; the snippet whole, or its first ``most`` characters."""
    x = F.col("x")
    snippet = F.coalesce(x["text"], F.lit(""))
    return df.select(key, F.explode(references(F.col("result"))).alias("x")).select(
        key,
        clean_url(x["url"]).alias("cited_url"),
        clean_domain(x["domain"]).alias("cited_domain"),
        F.coalesce(x["title"], F.lit("")).alias("cited_title"),
        (snippet if most is None else F.left(snippet, F.lit(most))).alias("cited_snippet"),
    )


def keyword_suggestions(df: DataFrame, body: str) -> DataFrame:
    """(keyword, search_volume, competition, cpc) from suggestion responses; items without a keyword are left out."""
    schema = (
        "tasks array<struct<result:array<struct<items:array<struct<keyword:string,"
        "keyword_info:struct<search_volume:bigint,competition_level:string,cpc:double>>>>>>>"
    )
    first = F.get(F.get(F.from_json(body, schema)["tasks"], 0)["result"], 0)["items"]
    info = F.col("x.keyword_info")
    return df.select(F.explode(first).alias("x")).where("x.keyword <> ''").select(
        "x.keyword",
        F.coalesce(info["search_volume"], F.lit(0)).alias("search_volume"),
        info["competition_level"].alias("competition"),
        info["cpc"].alias("cpc"),
    )


def expand_seeds(suggestions: DataFrame, seeds: DataFrame, least_volume: int = 0, most: int = 500) -> DataFrame:
    """(keyword, search_volume): seeds and suggestions, each once regardless of letter case, by falling volume.

    The spelling with the highest volume stands for a keyword. A report of the top ``most``.
    """
    both = suggestions.select("keyword", "search_volume").unionByName(
        seeds.select(F.col("keyword"), F.lit(0).cast("bigint").alias("search_volume"))
    )
    both = both.where(F.trim("keyword") != "").withColumn("keyword", F.trim("keyword"))
    best = both.groupBy(F.lower("keyword").alias("k")).agg(
        F.max_by("keyword", F.struct("search_volume", "keyword")).alias("keyword"), F.max("search_volume").alias("search_volume")
    )
    return best.where(F.col("search_volume") >= least_volume).orderBy(F.desc("search_volume"), "keyword").limit(most).drop("k")
