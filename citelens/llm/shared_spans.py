"""Problem 6: long stretches that stand verbatim in a passage row and in a line of a page.

Sliding sentence spans: from every sentence on, the shortest run of consecutive sentences that reaches ``least`` characters is
hashed, the hashes are joined globally, and what meets is verified and extended to its full length on the texts. Two texts
that share whole sentences of that length share such a run, from the first of them on.

A case is any ``least`` consecutive characters, though, and may begin and end within a sentence, where no run of sentences is
equal. So that none is lost, spans of GRAM characters are hashed beside the runs; of each stretch of ``least`` characters only
the one with the smallest hash is kept (a minimizer), about two spans per ``least - GRAM`` characters, and equal stretches
always send an equal span. ``inside=False`` leaves these out, to see what the runs of sentences find alone.

Texts are compared by class: a line that stands on many pages, or a sentence in many rows, is hashed and compared
once, and its class's members (page and line number, row and side) take over what is found. Classes have 128-bit keys.

Scale. Spans meet in one shuffled join on the 64-bit hash, of which adaptive execution splits a hot key. Only lines that
meet a sentence move as texts, one a class; pairs that meet are verified, and extended to their full length, on these two
texts alone. Pages are split into lines once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.llm.lines import SLICE, map_many, page_lines
from citelens.staging import spread, stage

LEAST = 100
GRAM = 40
_BASE = 0x9E3779B97F4A7C15
_SPACE = re.compile(r"\s+")


def _powers(n: int, base: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
        step = step * step
    return out


def minimizers(texts: list[str], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners): for each run of ``least`` characters of each text the smallest hash of its grams."""
    lengths = np.array([len(x) for x in texts], np.int64)
    if not len(texts) or lengths.max() < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    with np.errstate(over="ignore"):
        up, down = _powers(n + 1, _BASE), _powers(n + 1, pow(_BASE, -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up[:n], dtype=np.uint64)])
        h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    width, span = least - gram + 1, 1
    low = h
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(low)]
    inside = np.arange(len(low)) + least <= ends[owner]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    chosen = inside & new
    return low[chosen].view(np.int64), owner[chosen]


def collapse(text: str | None) -> str:
    return _SPACE.sub(" ", text) if text else ""


#: Between sentences: white space, and signs around it, after the end of one.
_SENTENCE_END = re.compile(r"(?<=[.!?…:;])[\s\"“”»)]+")


def sentence_runs(text: str, least: int = LEAST) -> list[str]:
    """From each sentence on, the shortest run of consecutive sentences that has ``least`` characters, if there is one."""
    parts = [x for x in _SENTENCE_END.split(text) if x]
    out, end, size = [], 0, -1
    for start in range(len(parts)):
        while size < least and end < len(parts):
            size += len(parts[end]) + 1
            end += 1
        if size < least:
            break
        out.append(" ".join(parts[start:end]))
        size -= len(parts[start]) + 1
    return out


def _hash(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def spans_of(texts: list[str], least: int, inside: bool) -> tuple[list[int], list[int]]:
    """(ends, hashes): the spans of each text one after the other; ends[i] is where those of text i end."""
    found = [[int.from_bytes(_hash(x)[:8], "little", signed=True) for x in sentence_runs(text, least)] for text in texts]
    if inside:
        for h, i in zip(*(x.tolist() for x in minimizers(texts, least))):
            found[i].append(h)
    return np.cumsum([0, *map(len, found)]).tolist(), [h for own in found for h in own]


def _texts(rows: DataFrame, split: Callable[..., list[tuple[int, str]]], least: int, inside: bool) -> DataFrame:
    """(id, part, key, text, spans): the texts of at least ``least`` characters of each row, which has its id first."""
    schema = pa.schema(
        [("id", pa.int64()), ("part", pa.int32()), ("key", pa.binary()), ("text", pa.string()), ("spans", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                ids, parts, texts = [], [], []
                for own, *values in zip(*(c.to_pylist() for c in batch.slice(start, SLICE).columns)):
                    for part, text in split(*values):
                        if len(text) >= least:
                            ids.append(own)
                            parts.append(part)
                            texts.append(text)
                ends, hashes = spans_of(texts, least, inside)
                arrays = [pa.array(x, t) for x, t in zip((ids, parts, map(_hash, texts), texts), schema.types)]
                spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes, pa.int64()))
                yield pa.RecordBatch.from_arrays([*arrays, spans], schema=schema)

    return rows.mapInArrow(run, "id bigint, part int, key binary, text string, spans array<bigint>")


def page_texts(pages: DataFrame, least: int = LEAST, inside: bool = True) -> DataFrame:
    """(id, part, key, text, spans): the lines of each page; part is the line's number."""
    narrow = spread(pages.select("page_id", "html").where(F.length("html") >= least)).where("page_id is not null")
    return _texts(narrow, lambda html: list(enumerate(page_lines(html))), least, inside)


def passage_texts(passages: DataFrame, least: int = LEAST, inside: bool = True) -> DataFrame:
    """(id, part, key, text, spans): both sentences of each row; part is 0 for aio_sentence, 1 for source_sentence."""
    narrow = passages.select("match_id", "aio_sentence", "source_sentence").where("match_id is not null")
    return _texts(narrow, lambda *both: list(enumerate(map(collapse, both))), least, inside)


def shared_runs(text: str, line: str, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in text, start in line, length) of each maximal common run of at least ``least`` characters."""
    half = (least + 1) // 2
    found = set()
    for at in range(0, len(text) - half + 1, least - half + 1):  # any long run holds one of these pieces whole
        piece = text[at : at + half]
        hit = line.find(piece)
        while hit >= 0:
            a, b = at, hit
            while a and b and text[a - 1] == line[b - 1]:
                a -= 1
                b -= 1
            c, d = at + half, hit + half
            while c < len(text) and d < len(line) and text[c] == line[d]:
                c += 1
                d += 1
            if c - a >= least:
                found.add((a, b, c - a))
            hit = line.find(piece, hit + 1)
    return sorted(found)


_RUNS = pa.schema(
    [("passage_key", pa.binary()), ("line_key", pa.binary())] + [(x, pa.int32()) for x in ("text_start", "line_start", "length")]
)
_RUNS_DDL = "passage_key binary, line_key binary, text_start int, line_start int, length int"


def _verify(least: int) -> Callable[..., list[tuple]]:
    def rows(passage_key: bytes, line_key: bytes, text: str, line: str) -> list[tuple]:
        return [(passage_key, line_key, *run) for run in shared_runs(text, line, least)]

    return rows


def _met(texts: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of the classes that are in ``pairs``, each once."""
    met = texts.join(pairs.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    return met.groupBy(F.col("key").alias(key)).agg(F.first("text").alias(text))


def class_runs(sentences: DataFrame, lines: DataFrame, least: int = LEAST) -> DataFrame:
    """(passage_key, line_key, text_start, line_start, length): the maximal shared runs of the classes of texts."""
    one, two = (
        x.select(F.col("key").alias(name), F.explode("spans").alias("h")).distinct()
        for x, name in ((sentences, "passage_key"), (lines, "line_key"))
    )
    pairs = stage(one.join(two, "h").select("passage_key", "line_key").distinct(), "span-pairs")
    texts = pairs.join(_met(sentences, pairs, "passage_key", "text"), "passage_key").join(
        _met(lines, pairs, "line_key", "line"), "line_key"
    )
    return map_many(texts.select("passage_key", "line_key", "text", "line"), _verify(least), _RUNS, _RUNS_DDL)


def _staged(passages: DataFrame, pages: DataFrame, least: int, inside: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    sentences, lines = stage(passage_texts(passages, least, inside), "span-passages"), stage(page_texts(pages, least, inside), "span-lines")
    return sentences, lines, stage(class_runs(sentences, lines, least), "span-runs")


def _members(texts: DataFrame, key: str, own: str, part: str) -> DataFrame:
    return texts.select(F.col("key").alias(key), F.col("id").alias(own), F.col("part").alias(part))


def shared_spans(passages: DataFrame, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(match_id, page_id, side, text_start, line_no, line_start, length): every maximal shared run.

    side 0 is aio_sentence, 1 is source_sentence; positions count characters from 0, in the sentence after its white space
    is collapsed. Null or short texts have no runs; a row without its id is left out; repeated rows and ids each give their
    runs; further columns are ignored.
    """
    sentences, lines, runs = _staged(passages, pages, least)
    return (
        runs.join(_members(sentences, "passage_key", "match_id", "side"), "passage_key")
        .join(_members(lines, "line_key", "page_id", "line_no"), "line_key")
        .select("match_id", "page_id", "side", "text_start", "line_no", "line_start", "length")
    )


def shared_pairs(passages: DataFrame, pages: DataFrame, least: int = LEAST, inside: bool = True) -> DataFrame:
    """(match_id, page_id) of the rows and pages that share a run."""
    sentences, lines, runs = _staged(passages, pages, least, inside)
    pairs = runs.select("passage_key", "line_key").distinct()
    one, two = _members(sentences, "passage_key", "match_id", "side"), _members(lines, "line_key", "page_id", "line_no")
    met = pairs.join(one.drop("side").distinct(), "passage_key").join(two.drop("line_no").distinct(), "line_key")
    return met.select("match_id", "page_id").distinct()


def _covered(runs: DataFrame, key: str, start: str) -> DataFrame:
    """(key, chars): characters under the union of the runs, by class."""
    spans = runs.groupBy(F.col(key).alias("key"), start).agg(F.max("length").alias("length"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(start).alias("a"), (F.col(start) + F.col("length")).alias("b"))))
    size = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["b"]).alias("end"),
            (acc["sum"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return spans.groupBy("key").agg(size.alias("chars"))


def shared_sizes(passages: DataFrame, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(kind, id, shared_chars): of each passage row and each page the characters that lie in shared runs.

    A text's starts are at most its own length in number, and runs with the same start count once, so that what is
    gathered for one class is bounded by its text. Rows with the same id count as one record, equal texts in them once.
    """
    sentences, lines, runs = _staged(passages, pages, least)
    sides = (
        ("passage", passages, "match_id", sentences, "passage_key", "text_start"),
        ("page", pages, "page_id", lines, "line_key", "line_start"),
    )
    out = None
    for kind, table, own, texts, key, start in sides:
        own_texts = texts.select("id", "part", "key").distinct()
        sums = own_texts.join(_covered(runs, key, start), "key").groupBy("id").agg(F.sum("chars").alias("chars"))
        part = (
            table.select(F.col(own).alias("id"))
            .join(sums, "id", "left")
            .select(F.lit(kind).alias("kind"), "id", F.coalesce("chars", F.lit(0)).cast("bigint").alias("shared_chars"))
        )
        out = part if out is None else out.unionByName(part)
    return out
