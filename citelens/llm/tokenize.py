"""Problem 7: encoding with a public byte-level BPE vocabulary; decoding.

A bounded-lookahead streaming transducer. From the vocabulary's merges follows a number of bytes, the sufficient lookahead,
by which a token boundary is stable: bytes further right can't move it. A piece of any length is therefore encoded in
windows, each emitting the tokens that end at least that far before the window's end; a stream's state is one window.
The vocabulary's pattern cuts a text into pieces one after the other. Every piece goes through the transducer; one that ends
within its first window, as nearly all words do, is that window's flush, and is kept in a table of bounded size. A window of
up to PLAIN bytes is merged by scanning for the lowest rank, a longer one with a heap: the same merges in the same order.
Decoding feeds the tokens' bytes to an incremental UTF-8 state machine.

Scale. One scan of two columns, no shuffle. A worker holds the vocabulary (50,000 entries), the table and one batch.
"""

from __future__ import annotations

import base64
import codecs
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.llm.lines import SLICE
from citelens.staging import spread

#: Where the vocabulary files lie on the driver; a parameter of every operator here.
VOCABULARIES = "/opt/tokenizers"
#: The pattern of byte_bpe_50k, from the vocabulary's documentation.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = 200
KEPT = 400_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The tokens of a rank file, by their bytes."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def read_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(read_file(path))


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a short piece: of all neighbours the pair of lowest rank is merged, the first of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pairs = [get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
    while pairs:
        low = min(pairs)
        if low == 1 << 30:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
    return parts


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same for a long piece, with a heap: n log n."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = parts[i]
        j = following[i]
        if left is None or j >= n or len(left) + len(parts[j]) != size:
            continue  # one of the two was merged since
        parts[i], parts[j] = left + parts[j], None
        following[i] = k = following[j]
        if k < n:
            preceding[k] = i
            both = parts[i] + parts[k]
            if (r := ranks.get(both)) is not None:
                heapq.heappush(heap, (r, i, len(both)))
        h = preceding[i]
        if h >= 0:
            both = parts[h] + parts[i]
            if (r := ranks.get(both)) is not None:
                heapq.heappush(heap, (r, h, len(both)))
    return [x for x in parts if x is not None]


def merge_window(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    return merge_short(piece, ranks) if len(piece) <= PLAIN else merge_long(piece, ranks)


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token boundary that can decide whether it stands.

    Whether a rule u+v applies at a place depends on what follows only if a rule x+y of lower rank, with x at the right end
    of v, applies first; that in turn depends on rules of still lower rank beyond y. The longest such chain of falling
    ranks is found rule by rule: reach(u+v) = |v| + the largest reach of an earlier rule whose left part ends v.
    """
    halves: dict[bytes, tuple[bytes, bytes]] = {}
    reach_of_left: dict[bytes, int] = {}
    longest = 1
    known: dict[bytes, int] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = merge_short(token, known)
            if len(parts) == 2:
                left, right = parts
                halves[token] = (left, right)
                end, beyond = right, 0
                while True:
                    beyond = max(beyond, reach_of_left.get(end, 0))
                    if end not in halves:
                        break
                    end = halves[end][1]
                reach = len(right) + beyond
                reach_of_left[left] = max(reach_of_left.get(left, 0), reach)
                longest = max(longest, reach)
        known[token] = rank
    return longest


class Encoder:
    """Encodes and decodes; ``lookahead`` as from ``sufficient_lookahead`` of the same vocabulary."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int, pattern: str = PATTERN):
        self.ranks, self.lookahead = ranks, lookahead
        self.window = max(4 * lookahead, 1024)
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.pieces = regex.compile(pattern).finditer
        self.kept: dict[str, tuple[int, ...]] = {}

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes in chunks, each as soon as it is stable."""
        ranks, held = self.ranks, b""
        for chunk in chunks:
            held += chunk
            if len(held) < self.window:
                continue
            sure, done = len(held) - self.lookahead, 0
            for token in merge_window(held, ranks):
                if done + len(token) > sure:
                    break
                done += len(token)
                yield ranks[token]
            held = held[done:]
        for token in merge_window(held, ranks):
            yield ranks[token]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece."""
        data = text.encode("utf-8")
        if len(data) >= self.window:
            return tuple(self.stream(data[i : i + self.window] for i in range(0, len(data), self.window)))
        whole = self.ranks.get(data)
        ids = tuple(self.stream((data,))) if whole is None else (whole,)
        if len(self.kept) >= KEPT:
            self.kept.clear()
        self.kept[text] = ids
        return ids

    def encode_into(self, text: str | None, out: array) -> None:
        """Append the ids of a text; null and empty texts have none."""
        if not text:
            return
        get, piece, add = self.kept.get, self.piece, out.extend
        for match in self.pieces(text):
            x = match[0]
            add(get(x) or piece(x))

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are whole; what isn't UTF-8 becomes U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := machine.decode(self.bytes_of[i]):
                yield part
        if part := machine.decode(b"", final=True):
            yield part


@lru_cache(4)
def encoder(path: str, lookahead: int) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(read_ranks(path), lookahead)


@lru_cache(4)
def lookahead_of(path: str) -> int:
    return sufficient_lookahead(read_ranks(path))


@lru_cache(4)
def _encoder_of(data: bytes, lookahead: int) -> Encoder:
    return Encoder(parse_ranks(data), lookahead)


def shared_encoder(df: DataFrame, name: str, folder: str) -> Callable[[], Encoder]:
    """What a worker calls for its encoder: the vocabulary file (about 1 MB) is read by the driver alone and sent along."""
    path = f"{folder}/{name}.tiktoken"
    shared = df.sparkSession.sparkContext.broadcast((read_file(path), lookahead_of(path)))
    return lambda: _encoder_of(*shared.value)


def encoded(
    texts: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES
) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens: their names are plain text.

    A null or empty text has an empty list; blank texts are encoded as they are. Repeated rows come out as often as they come
    in; further columns are ignored.
    """
    own_encoder = shared_encoder(texts, name, folder)
    narrow = spread(texts.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")))
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                flat, ends = array("i"), array("i", [0])
                for x in part.column(1).to_pylist():
                    own.encode_into(x, flat)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], schema=schema)

    return narrow.mapInArrow(run, f"`{key}` bigint, ids array<int>")


def decoded(rows: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, text) of every row; a null list has a null text, an empty one an empty text."""
    own_encoder = shared_encoder(rows, name, folder)
    schema = pa.schema([(key, pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                out = [None if x is None else "".join(own.decode(x)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], schema=schema)

    narrow = rows.select(F.col(key).cast("bigint").alias(key), F.col(ids).alias("ids"))
    return narrow.mapInArrow(run, f"`{key}` bigint, text string")


def round_trip(texts: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, tokens, characters, same) of every row: whether decoding its ids gives its text; null texts count as empty."""
    own_encoder = shared_encoder(texts, name, folder)
    narrow = spread(texts.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")))
    fields = [(key, pa.int64()), ("tokens", pa.int64()), ("characters", pa.int64()), ("same", pa.bool_())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = []
                for x in part.column(1).to_pylist():
                    ids = own.encode(x)
                    rows.append((len(ids), len(x or ""), "".join(own.decode(ids)) == (x or "")))
                columns = zip(*rows) if rows else [[], [], []]
                arrays = [pa.array(c, t) for c, t in zip(columns, schema.types[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], schema=schema)

    return narrow.mapInArrow(run, f"`{key}` bigint, tokens bigint, characters bigint, same boolean")
