"""Lines of a page, as TESTDATA.md defines them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
HIDDEN = re.compile(
    r"<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)", re.S | re.I
)
#: What follows a tag's name: quoted values are passed over whole; a quote that is never closed ends with the next ">".
#: Nothing is tried twice, so that broken pages take no longer than whole ones.
ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+(?:>|\Z|["'][^>]*+(?:>|\Z))"""
#: Tags that vanish without a trace; every other tag ends a line.
INLINE = re.compile(r"</?(?:a|b|strong|em|i|span|u)(?:>|\Z|(?=[\s/])" + ATTRIBUTES + ")", re.I)
BREAK = re.compile(r"<[/!?]?[a-z]" + ATTRIBUTES + r"|<[!?/][^>]*+(?:>|\Z)", re.I)


def page_lines(html: str | None) -> list[str]:
    """The lines in their order and writing; none for a null or empty page."""
    if not html:
        return []
    text = INLINE.sub("", HIDDEN.sub("<br>", COMMENT.sub("", html)))
    out = []
    for part in BREAK.split(text):
        if "&" in part:
            part = unescape(part)
        part = " ".join(part.split())
        if part:
            out.append(part)
    return out


#: Rows turned into Python objects at a time, to bound a worker's memory.
SLICE = 500


def map_many(df: DataFrame, rows: Callable[..., list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Any number of output rows for each input row, over Arrow batches; ``rows`` gets the values of all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                out: list[tuple] = []
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    out += rows(*values)
                columns = zip(*out) if out else [[]] * len(schema)
                arrays = [pa.array(c, t) for c, t in zip(columns, schema.types)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, ddl)
