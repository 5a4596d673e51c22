"""Problem 1: lines that a site repeats on very many of its pages.

Weighted graphs of consecutive lines: a node is a line of a site, weighted by the pages that have it; an edge joins
lines that follow each other on a page, weighted by the pages where they do. Nodes and edges of high support are kept,
connected components are the boilerplate blocks, and the occurrences of their lines are deleted from each page.

Every line of high support is a node, and a node without edges a block of its own: which lines go is decided by the nodes,
while the edges say which lines belong together (``block_table``).

Scale. Lines are counted as (site, 64-bit hash), so that map-side aggregation shrinks what repeats and unique lines move
as 16 bytes. A node stands on at least ``share`` of its site's pages, so a site has at most (mean lines per page)/share
nodes, whatever its size: nodes, edges and components of one site are small by proof and are kept as arrays in one row.
Pages meet their site's row in a join on the site, where adaptive execution splits a hot site's pages.
The few lines whose hash is a node are then counted again by their text, so that no two lines are taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.functions.site import site_of
from citelens.llm.lines import map_many, page_lines
from citelens.staging import spread, stage

_LINES = pa.schema([("page_id", pa.int64()), ("site", pa.string()), ("lines", pa.list_(pa.string()))])


def _distinct_lines(page_id: int | None, site: str | None, html: str | None) -> list[tuple]:
    return [(page_id, site, list(dict.fromkeys(x.lower() for x in page_lines(html))))]


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, site, lines) of every page: lines in lower case, each once, in their order."""
    narrow = spread(pages.select("page_id", "url", "html")).select("page_id", site_of(F.col("url")).alias("site"), "html")
    return map_many(narrow, _distinct_lines, _LINES, "page_id bigint, site string, lines array<string>")


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line, by the alphabet, of each node's component, from a site's nodes and edges."""
    for batch in batches:
        sites, nodes, edges = (c.to_pylist() for c in batch.columns)
        blocks = []
        for own, pairs in zip(nodes, edges):
            root = {x: x for x in own}

            def find(x: str, root: dict[str, str] = root) -> str:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for pair in pairs or []:
                if pair["a"] in root and pair["b"] in root:
                    a, b = find(pair["a"]), find(pair["b"])
                    root[max(a, b)] = min(a, b)
            blocks.append([(x, find(x)) for x in own])
        yield pa.RecordBatch.from_arrays(
            [pa.array(sites, pa.string()), pa.array(blocks, pa.map_(pa.string(), pa.string()))], ["site", "blocks"]
        )


def site_blocks(lines: DataFrame, min_pages: int = 5, min_share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """The pages' boilerplate lines and the sites' blocks, from ``lines_of_pages``.

    Returns (page_id, site, hits array<struct<pos, line>>) and (site, blocks map<line, block>); only hits that are among
    the site's blocks are boilerplate. A page without a site or without lines is in neither.
    """
    lines = lines.where("site is not null and size(lines) > 0")
    pages = stage(lines.groupBy("site").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages), "site-pages")

    def frequent(each: DataFrame, name: str) -> DataFrame:
        """(site, name): the values x of (site, x) that stand on enough pages."""
        counted = each.groupBy("site", "x").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
        often = counted.join(pages, "site").where(F.col("n") >= min_share * F.col("pages"))
        return often.groupBy("site").agg(F.collect_list("x").alias(name))

    hashes = stage(frequent(lines.select("site", F.explode(F.transform("lines", lambda x: F.xxhash64(x))).alias("x")), "hashes"), "site-hashes")
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    hits = stage(
        lines.join(hashes, "site")
        .select("page_id", "site", F.filter(numbered, lambda x: F.array_contains("hashes", F.xxhash64(x["line"]))).alias("hits"))
        .where(F.size("hits") > 0),
        "site-hits",
    )
    nodes = frequent(hits.select("site", F.explode("hits.line").alias("x")), "lines")
    follows = F.filter(
        F.zip_with(
            F.slice("hits", 1, F.greatest(F.size("hits") - 1, F.lit(0))),
            F.slice("hits", 2, F.size("hits")),
            lambda x, y: F.when(y["pos"] == x["pos"] + 1, F.struct(x["line"].alias("a"), y["line"].alias("b"))),
        ),
        lambda x: x.isNotNull(),
    )
    edges = frequent(hits.select("site", F.explode(follows).alias("x")), "edges")
    blocks = nodes.join(edges, "site", "left").select("site", "lines", "edges")
    return hits, blocks.mapInArrow(_components, "site string, blocks map<string,string>")


def repeated_lines(pages: DataFrame, min_pages: int = 5, min_share: float = 0.25) -> DataFrame:
    """(page_id, site, line, block): each occurrence of a boilerplate line, once per page; a block is called by its first line.

    ``pages`` needs page_id, url and html; further columns are ignored. Null or empty html and pages without a site give
    no rows; a repeated row counts as a page of its own; ties don't arise, since thresholds are inclusive.
    """
    hits, blocks = site_blocks(stage(lines_of_pages(pages), "page-lines"), min_pages, min_share)
    return (
        hits.join(blocks, "site")
        .select("page_id", "site", "blocks", F.explode("hits.line").alias("line"))
        .select("page_id", "site", "line", F.col("blocks")[F.col("line")].alias("block"))
        .where("block is not null")
    )


def without_repeated_lines(pages: DataFrame, min_pages: int = 5, min_share: float = 0.25) -> DataFrame:
    """(page_id, removed, text): every page, its remaining lines in lower case joined by line ends.

    A page without lines has an empty text; a page without a site keeps all its lines; repeated rows come out each.
    """
    lines = stage(lines_of_pages(pages), "page-lines")
    _, blocks = site_blocks(lines, min_pages, min_share)
    known = lines.join(blocks.select("site", F.map_keys("blocks").alias("known")), "site", "left")
    kept = F.when(F.col("known").isNull(), F.col("lines")).otherwise(F.array_except("lines", "known"))
    return known.select(
        "page_id", (F.size("lines") - F.size(kept)).alias("removed"), F.array_join(kept, "\n").alias("text")
    )


def block_table(pages: DataFrame, min_pages: int = 5, min_share: float = 0.25) -> DataFrame:
    """(site, block, lines, pages): the sites' boilerplate blocks with their lines and the pages that have any of them."""
    found = repeated_lines(pages, min_pages, min_share)
    return found.groupBy("site", "block").agg(
        F.array_sort(F.collect_set("line")).alias("lines"), F.count_distinct("page_id").alias("pages")
    )
