"""Schemas of the engine's tables, and checks of the columns that an input brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL_RANK = 101

#: The contractual columns of candidates, in order.
CANDIDATES = (
    "query_id string, query string, url string, organic_rank int, domain_rating double, page_authority double, "
    "word_count int, has_schema int, num_lists_tables int, has_faq int, query_url_similarity double, "
    "passage_match_score double, content_freshness_days int, num_entities_matched int, readability_score double, "
    "is_https int, domain_citation_rate double, is_forum int, is_video int, content_type string, cited int"
)

# Result types that are counted as features of a search.
SERP_FEATURES = (
    "local_pack map people_also_ask knowledge_graph featured_snippet related_searches images video paid "
    "top_stories shopping answer_box carousel"
).split()
SERP_FEATURES_WIDE = (
    "local_pack map people_also_ask knowledge_graph featured_snippet related_searches images video paid compare_sites "
    "people_also_search twitter top_stories shopping answer_box carousel"
).split()
# Numeric features of a page's content; rank features come on top of them where ranks are known.
CONTENT_FEATURES = (
    "word_count has_schema num_lists_tables has_faq structure_score query_url_similarity passage_match_score "
    "content_freshness_days num_entities_matched readability_score is_https is_forum is_video"
).split()
RANK_FEATURES = ["organic_rank", "rank_reciprocal"]

REFERENCE = "struct<type:string,source:string,domain:string,url:string,title:string,text:string>"
TRANSCRIPT = (
    "video_id string, language string, language_code string, is_generated boolean, n_snippets int, duration_s double, "
    "text string, snippets array<struct<start:double,text:string>>"
)
PAGE = "url string, html string, ok boolean, status int"


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself; a ValueError names the missing columns in order."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def stable_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns first, in that order, then the others as they come."""
    return require_columns(df, names).select(*names, *[x for x in df.columns if x not in names])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any floating column as NULL, which SQL aggregates skip."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in floats})
