"""Problem 3: records that are the same but for their writing.

Canonical records are range-partitioned by (128-bit hash, row id) and sorted by (hash, key, row id), each partition's sort
spilling to disk as it needs. A scan then compares the full keys of adjacent rows: a run of equal keys is a class, its first
row the one that stands for it.

Scale. The row id is part of the range key, so that a class that holds a third of all rows is cut into as many ranges as
its size needs. A run may thus go on in later partitions; the hashes of the partitions' first and last keys (two rows each,
bounded by the number of partitions) tell which first row it has, and no class is ever gathered anywhere. Range sampling
and border rows bring hashes to the driver, never keys: their size follows the number of partitions, not the rows or their
texts. The canonical records are written once: the sampling for the ranges and the sort both read that narrow table instead
of working keys out again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.llm.lines import map_many
from citelens.staging import spread, stage

_WORD = re.compile(r"[^\W_]+")
_LABEL = re.compile(r"\[[^\]]*\]\s*\((.*)\)", re.S)
_OPENERS = "<(\"'„“‚‘«‹»›`"
_CLOSERS = ">\"'“”‘’«»‹›`]"
_PUNCTUATION = ".,;:!?…"
_SCHEME = re.compile(r"(?:[a-z][a-z0-9+.\-]*:)?//", re.I)


def canonical_query(query: str | None) -> str | None:
    """Its words (letters and digits) in lower case and composed form; None for None."""
    if query is None:
        return None
    return " ".join(_WORD.findall(unicodedata.normalize("NFC", query.lower())))


def _plain(text: str) -> str:
    """Percent-escapes decoded; bytes that aren't UTF-8 keep an escaped form."""
    return unquote_to_bytes(text).decode("utf-8", "backslashreplace") if "%" in text else text


def _unwrap(text: str) -> str:
    """Without the white space, brackets, quotes, link label and final punctuation around a url."""
    start, end = 0, len(text)
    opened, closed = text.count("("), text.count(")")
    parameters, labels = "?" in text, text.rfind("](")
    while True:
        before = start, end
        while end > start and (text[end - 1].isspace() or text[end - 1] in _PUNCTUATION):
            end -= 1
        while start < end and (text[start].isspace() or text[start] in _OPENERS):
            opened -= text[start] == "("
            start += 1
        if start == end:
            return ""
        if text[start] == "[":
            label = _LABEL.fullmatch(text, start, end) if labels > start else None
            if label:
                start, end = label.span(1)
                opened, closed = text.count("(", start, end), text.count(")", start, end)
                continue
            if labels < start:
                start += 1
        last = text[end - 1] if end > start else ""
        if last and last in _CLOSERS:
            end -= 1
        elif last == ")" and closed > opened:
            closed -= 1
            end -= 1
        elif last == "/" and (not parameters or text[end - 2].isspace() or text[end - 2] in _CLOSERS + ")"):
            end -= 1
        if (start, end) == before:
            return text[start:end]


def canonical_url(url: str | None) -> str | None:
    """None for a null url or one with nothing in it."""
    if not url:
        return None
    text = _unwrap(url)
    text = text[m.end() :] if (m := _SCHEME.match(text)) else text
    text, hash_, fragment = text.partition("#")
    text, _, parameters = text.partition("?")
    host, _, path = text.partition("/")
    host = host.lower().removeprefix("www.")
    path = "/".join(x for x in _plain(path).split("/") if x)
    names = sorted(_plain(x) for x in parameters.split("&") if x)
    if not (host or path or names):
        return None
    return "\x1e".join([host, path, *names]) + (hash_ + fragment if fragment else "")


_KEYED = pa.schema([("row_id", pa.int64()), ("key", pa.string())])


def _key(row_id: int | None, query_id: str | None, query: str | None, url: str | None, *rest: str | None) -> list[tuple]:
    address = canonical_url(url)
    if row_id is None:
        return []
    if query_id is None or address is None:
        return [(row_id, f"\x1d{row_id}")]
    parts = (query_id, canonical_query(query), address, *rest)
    return [(row_id, "\x1f".join("\x00" if x is None else x for x in parts))]


def keyed(records: DataFrame, *fields: str) -> DataFrame:
    """(row_id, key); ``fields`` must agree too, null with null. A record that can have no copies has a key of its own."""
    rest = [F.col(x).cast("string").alias(f"field_{i}") for i, x in enumerate(fields)]
    narrow = spread(records.select("row_id", "query_id", "query", "url", *rest))
    return map_many(narrow, _key, _KEYED, "row_id bigint, key string")


_RUNS = pa.schema(
    [
        ("part", pa.int32()),
        ("table_name", pa.string()),
        ("row_id", pa.int64()),
        ("first_id", pa.int64()),
        ("head", pa.bool_()),
        ("edge", pa.string()),
    ]
)
_HASHES = ("h", "g")
_RUNS_DDL = "part int, table_name string, row_id bigint, first_id bigint, head boolean, edge string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in a sorted partition; edge: the key's hash, on the partition's first and last row."""
    part = TaskContext.get().partitionId()
    key = first = waiting = None
    last = ""
    head = True

    def out(columns: list, edges: list) -> pa.RecordBatch:
        tables, ids, firsts, heads = columns
        n = len(ids)
        arrays = [pa.array(np.full(n, part, np.int32)), tables, pa.array(ids), pa.array(firsts), pa.array(heads)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(edges, pa.string())], schema=_RUNS)

    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting:
            yield out(*waiting)
        tables, ids, keys = batch.column("table_name"), batch.column("row_id").to_numpy(), batch.column("key")
        hashes = [batch.column(x) for x in _HASHES]
        new = np.ones(len(ids), bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        new[0] = keys[0].as_py() != key
        run = np.cumsum(new)
        starts = np.concatenate([[0 if first is None else first], ids[new]])
        firsts = starts[run]
        heads = np.full(len(ids), head) & (run <= (0 if begun else 1))
        edges: list[str | None] = [None] * len(ids)
        if not begun:
            edges[0] = " ".join(str(x[0]) for x in hashes)
        begun, head = True, bool(heads[-1])
        key, first = keys[len(keys) - 1].as_py(), firsts[-1]
        last = " ".join(str(x[len(x) - 1]) for x in hashes)
        waiting = ([tables, ids, firsts, heads], edges)
    if waiting:
        waiting[1][-1] = last
        yield out(*waiting)


def classes(records: DataFrame) -> DataFrame:
    """(table_name, row_id, first_id) from (table_name, row_id, key): first_id is the smallest row id with the same key.

    Keys of different tables must differ. No record may lack its key or row id; a repeated row is its own copy.
    """
    spark = records.sparkSession
    hashed = records.withColumn("h", F.xxhash64("key")).withColumn("g", F.xxhash64(F.lit(1), "key"))
    runs = stage(
        hashed.repartitionByRange(*_HASHES, "row_id")
        .sortWithinPartitions(*_HASHES, "key", "row_id")
        .select("table_name", "row_id", "key", *_HASHES)
        .mapInArrow(_scan, _RUNS_DDL),
        "copy-runs",
    )
    ends: dict[int, list] = {}
    for x in runs.where("edge is not null").collect():  # at most two rows of each partition
        ends.setdefault(x["part"], []).append(x)
    true_first, last_edge, last_first = [], None, None
    for part in sorted(ends):
        head = next(x for x in ends[part] if x["head"])
        tail = next((x for x in ends[part] if not x["head"]), None)
        first = head["first_id"]
        if head["edge"] == last_edge:
            first = last_first
            true_first.append((part, first))
        last_edge, last_first = (tail["edge"], tail["first_id"]) if tail else (head["edge"], first)
    if not true_first:
        return runs.select("table_name", "row_id", "first_id")
    mended = F.broadcast(spark.createDataFrame(true_first, "part int, mended bigint").withColumn("head", F.lit(True)))
    return runs.join(mended, ["part", "head"], "left").select(
        "table_name", "row_id", F.coalesce("mended", "first_id").alias("first_id")
    )


def keyed_tables(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(table_name, row_id, key) of both tables, written once; a record that can have no copies has its id as key."""
    parts = (
        ("candidates", candidates, ("organic_rank",)),
        ("label_validation", labels, ("is_ranked", "label", "expected")),
    )
    one, two = (
        keyed(table, *fields).select(
            F.lit(name).alias("table_name"), "row_id", F.concat(F.lit(name[0] + "\x1f"), "key").alias("key")
        )
        for name, table, fields in parts
    )
    return stage(one.unionByName(two), "copy-keys")


def copies(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(table_name, first_id, copy_id): one row for each copy but the one with the smallest row id.

    Null query_id, null or empty url: the row has no copies. Null queries are equal to each other, and so are nulls in
    organic_rank, is_ranked, label and expected. A row without its row id is left out; empty tables give no rows; further
    columns are ignored.
    """
    found = classes(keyed_tables(candidates, labels)).where("row_id <> first_id")
    return found.select("table_name", "first_id", F.col("row_id").alias("copy_id"))


def collapsed(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(table_name, row_id, copies): one row for each class, with the number of rows it stands for."""
    return (
        classes(keyed_tables(candidates, labels))
        .groupBy("table_name", F.col("first_id").alias("row_id"))
        .agg(F.count("*").alias("copies"))
    )
