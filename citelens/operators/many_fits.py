"""Boosted trees of many fits over the same rows: each fit grows in a task of its own, over bins that all fits share.

The trees are those of ``models.gbt`` (log loss, variance gain, categories in the order of their means) with its limits or
others: leaves are opened by falling gain until there are ``leaves`` of them or none is above ``depth``. What differs is which
rows a round draws, by a hash of the row, and that the borders of the bins come from all rows, not from each fit's own.
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelens.operators.validation import _xxhash_int
from citelens.staging import stage

#: Rows whose codes are added up at once, which keeps them in a core's cache; most codes of features that share a column; bytes
#: from which a fit's arrays lie in a file of the task instead of its memory.
STRIDE, JOINT, IN_MEMORY = 8192, 128, 1 << 28
#: Roles of a row in a fit: none, trained on with label 0 or 1, scored with label 0 or 1.
TRAIN, TEST = 1, 3


@dataclass
class Fit:
    """A model of the rows in ``train``, which scores those in ``test``; ``tags`` name it in the result.

    With ``least``, a fit with fewer rows to score or with one class only to train on is left out.
    """

    tags: dict[str, str | int]
    train: Column
    test: Column
    label: str
    numeric: Sequence[str]
    weights: tuple[float, float] = (1.0, 1.0)
    least: int = 0


@dataclass(frozen=True)
class Growth:
    """Rounds, the weight of each after the first, limits of a tree, and what a round draws of the rows and features."""

    trees: int
    step: float
    depth: int | None
    leaves: int | None
    least_rows: int
    share: float
    columns: float
    seed: int

    def most_leaves(self) -> int:
        return min(self.leaves or 2**30, 2**30 if self.depth is None else 2**self.depth)


@dataclass
class Forest:
    """The trees of a fit, trees x nodes; node 0 is a root. ``feature`` is -1 at leaves; a row whose bin is at most ``cut``, or of
    a category in ``sets``, goes to the node ``child``, others to the one after it."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    sets: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def empty(cls, trees: int, nodes: int) -> Forest:
        shape = (trees, nodes)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape, np.min_scalar_type(nodes)), np.zeros(shape))

    def values(self, at: int, bins: np.ndarray) -> np.ndarray:
        """The value of tree ``at`` for each column of ``bins`` (features x rows)."""
        inner = np.flatnonzero(self.feature[at] >= 0)
        if not len(inner):
            return np.full(bins.shape[1], self.value[at, 0])
        right = np.zeros((self.feature.shape[1], 256), np.intp)
        right[inner] = np.arange(256) > self.cut[at, inner, None]
        feature, child = np.maximum(self.feature[at], 0).astype(np.intp), np.arange(self.feature.shape[1])
        child[inner] = self.child[at, inner]
        for k in inner:
            if (at, k) in self.sets:
                own = self.sets[at, k]
                right[k, : len(own)] = ~own
        node, rows = np.zeros(bins.shape[1], np.intp), np.arange(bins.shape[1])
        while (self.feature[at].take(node) >= 0).any():
            node = child.take(node) + right[node, bins[feature.take(node), rows]]
        return self.value[at].take(node)

    def margins(self, bins: np.ndarray, step: float) -> np.ndarray:
        out = np.zeros(bins.shape[1])
        for at in range(len(self.feature)):
            out += (step if at else 1.0) * self.values(at, bins)
        return out


class Layout:
    """Columns of codes that stand for a fit's features: features of few bins share a column, each combination being a code.

    ``widths`` are the features' bins; the last feature is the category. Sums by bin have those features first that share columns.
    """

    def __init__(self, widths: Sequence[int]) -> None:
        self.widths, columns, size = list(widths), [], 0
        for f in sorted(range(len(widths)), key=lambda f: (widths[f], f)):
            if columns and size * widths[f] <= JOINT:
                columns[-1].append(f)
                size *= widths[f]
            else:
                columns.append([f])
                size = widths[f]
        self.columns = columns = sorted(columns, key=lambda fs: len(fs) == 1)
        self.sizes = [int(np.prod([widths[f] for f in fs])) for fs in columns]
        self.bases = [0, *accumulate(self.sizes)]
        self.place = {f: (c, int(np.prod([widths[g] for g in fs[:k]]))) for c, fs in enumerate(columns) for k, f in enumerate(fs)}
        self.bins = [np.arange(self.sizes[c]) // factor % widths[f] for f, (c, factor) in sorted(self.place.items())]  # of each code of its column
        shared = [fs for fs in columns if len(fs) > 1]
        self.joint = [(slice(self.bases[c], self.bases[c + 1]), np.concatenate([self.bins[f][:, None] == np.arange(widths[f]) for f in fs], axis=1).astype(float)) for c, fs in enumerate(shared)]
        self.alone = slice(self.bases[len(shared)], self.bases[-1])
        order = [f for fs in columns for f in fs]
        ends = [0, *accumulate(widths[f] for f in order)]
        self.start = dict(zip(order, ends))
        self.total = ends[-1]
        self.feature = np.repeat(order, [widths[f] for f in order])
        self.segment = np.repeat(np.arange(len(order)), [widths[f] for f in order])
        self.before = np.array(ends[1:-1]) - 1
        self.last = np.zeros(self.total, bool)
        self.last[np.array(ends[1:]) - 1] = True
        self.turn = self.feature * 256 + np.arange(self.total) - np.array(ends)[self.segment]  # by feature and bin

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """rows x columns, of bins (features x rows)."""
        out = np.empty((bins.shape[1], len(self.columns)), np.min_scalar_type(self.bases[-1]))
        for c, fs in enumerate(self.columns):
            out[:, c] = self.bases[c] + sum(bins[f].astype(np.intp) * self.place[f][1] for f in fs)
        return out

    def by_bin(self, sums: np.ndarray) -> np.ndarray:
        """Sums of the features' bins, from sums of the codes."""
        return np.concatenate([*(sums[:, codes] @ each for codes, each in self.joint), sums[:, self.alone]], axis=1)

    def whole(self, stats: np.ndarray) -> np.ndarray:
        return stats[:, : int(self.before[0]) + 1 if len(self.before) else self.total].sum(axis=1)


def _left(sums: np.ndarray, layout: Layout, spots: np.ndarray) -> np.ndarray:
    """The sum of a feature's bins up to each of ``spots``."""
    summed, before = sums.cumsum(), np.zeros(len(layout.before) + 1)
    before[1:] = summed[layout.before]
    return summed[spots] - before[layout.segment[spots]]


def best_split(stats: np.ndarray, layout: Layout, spots: np.ndarray, least: int) -> tuple | None:
    """(gain, feature, left bins, left sums, right sums) of the best split of a node, if any; the first of equals.

    ``stats`` are rows, sum and weight by feature and bin, without weights rows and sum. ``spots`` are the last bins on the left.
    """
    f = len(layout.widths) - 1
    begin, width = layout.start[f], layout.widths[f]
    s, w = (stats[k, begin : begin + width].tolist() for k in (1, 2 if len(stats) == 3 else 0))
    order = sorted(range(width), key=lambda k: s[k] / w[k] if w[k] > 0 else np.inf)
    if order != list(range(width)):
        stats = stats.copy()
        stats[:, begin : begin + width] = stats[:, [begin + k for k in order]]
    whole = layout.whole(stats)
    n = _left(stats[0], layout, spots)
    ok = np.flatnonzero((n >= least) & (n <= whole[0] - least))
    left = [n[ok], *(_left(x, layout, spots[ok]) for x in stats[1:])]
    if len(left) == 3:
        own = np.flatnonzero((left[2] > 0) & (whole[2] - left[2] > 0))
        ok, left = ok[own], [x[own] for x in left]
    if not len(ok):
        return None
    (n, ls, *w), whole_w = left, whole[2 if len(left) == 3 else 0]
    lw = w[0] if w else n
    gain = ls**2 / lw + (whole[1] - ls) ** 2 / (whole_w - lw) - whole[1] ** 2 / whole_w
    best = int(gain.argmax())
    if not gain[best] > 0:
        return None
    equal = np.flatnonzero(gain == gain[best])
    if len(equal) > 1:
        best = int(equal[layout.turn[spots[ok[equal]]].argmin()])
    i = int(spots[ok[best]])
    found = int(layout.feature[i])
    goes = np.arange(layout.widths[found]) <= i - layout.start[found]
    if found == f:
        goes = np.isin(np.arange(width), order[: i - begin + 1])
    sums = np.array([x[best] for x in left])
    return float(gain[best]), found, goes, sums, whole - sums


def _room(shape: tuple[int, ...], kind: type, rows: int) -> np.ndarray:
    """An array of a fit; with many rows in a file that is gone with it."""
    if rows * 64 <= IN_MEMORY:
        return np.empty(shape, kind)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
        return np.memmap(file, kind, "w+", shape=shape)


def _whole(x: np.ndarray) -> np.ndarray:
    """Rounded to 2**-30: sums over two million rows are exact, so that trees don't depend on the order of the rows."""
    return np.rint(x * 2.0**30) / 2.0**30


def grow(bins: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]], rows: int, widths: Sequence[int], weights: tuple[float, float], how: Growth) -> Forest:
    """The trees of a fit on ``rows`` rows: blocks of bins (features x rows), labels, and hashes where a round draws of the rows.

    A node holds a stretch of ``order``. Of two new nodes, the smaller one's rows are added up; the other has the rest.
    """
    layout, most = Layout(widths), how.most_leaves()
    codes, positive = _room((rows, len(layout.columns)), np.min_scalar_type(layout.bases[-1]), rows), _room((rows,), bool, rows)
    hashes = _room((rows,), np.uint64, rows) if how.share < 1 else None
    at = 0
    for b, y, h in bins:
        to = slice(at, at + b.shape[1])
        codes[to], positive[to] = layout.codes(b), y
        if hashes is not None:
            hashes[to] = h
        at = to.stop
    margin, target, order = (_room((rows,), kind, rows) for kind in (float, float, np.int32))
    weighted, size, n_columns = weights != (1.0, 1.0), layout.bases[-1], len(layout.columns)
    forest = Forest.empty(how.trees, 2 * most - 1)
    steps = [slice(a, min(a + STRIDE, rows)) for a in range(0, rows, STRIDE)]

    def added(a: int, b: int) -> np.ndarray:
        out = np.zeros((2 + weighted, size))
        for x in range(a, b, STRIDE):
            mine = order[x : min(x + STRIDE, b)]
            code = codes.take(mine, axis=0).ravel().astype(np.intp)
            out[0] += np.bincount(code, minlength=size)
            t = target.take(mine)
            if weighted:
                w = _whole(np.where(positive.take(mine), weights[1], weights[0]))
                out[2] += np.bincount(code, np.repeat(w, n_columns), size)
                t = _whole(t * w)
            out[1] += np.bincount(code, np.repeat(t, n_columns), size)
        return layout.by_bin(out)

    def parted(a: int, b: int, f: int, goes: np.ndarray) -> int:
        """Brings the rows that go left to the front; where the others begin."""
        column, others, to = layout.place[f][0], [], a
        left = goes[layout.bins[f]]
        for x in range(a, b, STRIDE):
            mine = order[x : min(x + STRIDE, b)].copy()
            own = left.take(codes[mine, column].astype(np.intp) - layout.bases[column])
            first = mine[own]
            order[to : to + len(first)] = first
            to += len(first)
            others.append(mine[~own])
        order[to:b] = np.concatenate(others) if len(others) > 1 else others[0]
        return to

    for at in range(how.trees):
        drawn = 0
        for x in steps:
            if at:
                y = np.where(positive[x], 1.0, -1.0)
                target[x] = _whole(4 * y / (1 + np.exp(2 * y * margin[x])))
            else:
                target[x], margin[x] = np.where(positive[x], 1.0, -1.0), 0.0
            mine = np.arange(x.start, x.stop, dtype=np.int32)
            if hashes is not None:
                u = _xxhash_int(_xxhash_int(hashes[x], np.array(at, np.uint64)), np.array(how.seed & 0xFFFFFFFF, np.uint64)) >> np.uint64(11)
                mine = mine[u < how.share * 2.0**53]
            order[drawn : drawn + len(mine)] = mine
            drawn += len(mine)
        n_open = max(1, round(how.columns * len(widths)))
        opened = np.isin(np.arange(len(widths)), np.random.default_rng((how.seed & 0xFFFFFFFF, at)).permutation(len(widths))[:n_open])
        spots = np.flatnonzero(opened[layout.feature] & ~layout.last)
        stretch, deep, n_nodes, heap = {0: (0, drawn)}, {0: 0}, 1, []

        def offer(node: int, stats: np.ndarray) -> None:
            found = best_split(stats, layout, spots, how.least_rows)
            if found:
                heapq.heappush(heap, (-found[0], node, found, stats))

        def may_split(node: int) -> bool:
            a, b = stretch[node]
            return b - a >= 2 * how.least_rows and (how.depth is None or deep[node] < how.depth) and n_nodes < 2 * most - 1

        root = added(0, drawn)
        whole = layout.whole(root)
        forest.value[at, 0] = whole[1] / whole[-1 if weighted else 0] if drawn else 0.0
        if may_split(0):
            offer(0, root)
        while heap and n_nodes < 2 * most - 1:
            _, node, (_, f, goes, *sums), stats = heapq.heappop(heap)
            (a, b), new = stretch.pop(node), n_nodes
            middle = parted(a, b, f, goes)
            forest.feature[at, node], forest.child[at, node] = f, new
            if f == len(widths) - 1:
                forest.sets[at, node] = goes
            else:
                forest.cut[at, node] = goes.sum() - 1
            n_nodes += 2
            for k, own, side in ((new, (a, middle), sums[0]), (new + 1, (middle, b), sums[1])):
                stretch[k], deep[k] = own, deep[node] + 1
                forest.value[at, k] = side[1] / side[-1 if weighted else 0]
            if may_split(new) or may_split(new + 1):
                small = new if middle - a <= b - middle else new + 1
                large = 2 * new + 1 - small
                own = added(*stretch[small])
                rest = stats - own
                rest[1:] *= rest[0] > 0  # beyond exact sums, what rounding leaves would part equal splits
                for k, x in ((small, own), (large, rest)):
                    if may_split(k):
                        offer(k, x)
        scale = how.step if at else 1.0
        for k, (a, b) in stretch.items():
            for x in range(a, b, STRIDE):
                margin[order[x : min(x + STRIDE, b)]] += scale * forest.value[at, k]
        if drawn < rows:
            left_out = np.ones(rows, bool)
            left_out[order[:drawn]] = False
            for x in steps:
                mine = x.start + np.flatnonzero(left_out[x])
                own = codes[mine].astype(np.intp)
                back = np.stack([layout.bins[f][own[:, layout.place[f][0]] - layout.bases[layout.place[f][0]]] for f in range(len(widths))])
                margin[mine] += scale * forest.values(at, back)
    return forest


def borders(rows: DataFrame, numeric: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper borders of each feature's bins: its values where there are few, else approximate quantiles."""
    clean = rows.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in numeric))
    probs = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    found = clean.agg(*(F.percentile_approx(c, probs, F.lit(10000)).alias(c) for c in numeric), *(F.approx_count_distinct(c).alias(f"_n_{c}") for c in numeric)).first()
    few = [c for c in numeric if found[f"_n_{c}"] <= bins * 5 // 4]
    values = {c: [] for c in few}
    if few:
        for r in clean.select(*few).unpivot([], few, "name", "v").where("v is not null").distinct().collect():
            values[r["name"]].append(r["v"])
    out = []
    for c in numeric:
        own = sorted(values[c])[:-1] if c in values and len(values[c]) <= bins else found[c]
        out.append(np.unique(np.array(own or [], float)))
    return out


def _blocks(
    rows: DataFrame, fits: Sequence[Fit], numeric: Sequence[str], category: str, key: str, group: str, bins: int
) -> tuple[DataFrame, list[int]]:
    """(bins, hashes, keys, groups, role_0, role_1, ...) of blocks of rows, staged; the features' numbers of bins.

    A fit reads its own column of roles only.
    """
    cuts = borders(rows, numeric, bins)
    kinds = [r[0] for r in rows.groupBy(category).count().orderBy(F.desc("count"), category).select(category).collect()]
    if len(kinds) > 256:
        raise ValueError(f"{category} has over 256 values")
    codes, n_fits = {k: i for i, k in enumerate(kinds)}, len(fits)
    n_numeric, names = len(numeric), ["bins", "hashes", "keys", "groups", *(f"role_{i}" for i in range(n_fits))]

    def role(f: Fit) -> Column:
        y = F.col(f.label).cast("int")
        return F.coalesce(F.when(f.train, y + TRAIN).when(f.test, y + TEST), F.lit(0)).cast("byte")

    cores = rows.sparkSession.sparkContext.defaultParallelism
    made = rows.select(key, group, F.xxhash64(key).alias("_h"), category, *numeric, F.array(*map(role, fits)).alias("_roles"))
    lists = {"keys": key, "groups": group}
    schema = T.StructType([T.StructField(c, T.ArrayType(rows.schema[lists[c]].dataType) if c in lists else T.BinaryType()) for c in names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            own = [np.searchsorted(cuts[i], b.column(4 + i).to_numpy(zero_copy_only=False).astype(float)) for i in range(n_numeric)]
            own.append(np.array([codes[x] for x in b.column(3).to_pylist()]))
            roles = b.column(4 + n_numeric).flatten().to_numpy(zero_copy_only=False).reshape(n, n_fits).T.astype(np.uint8)
            first, *others = (pa.array([x.tobytes()], pa.binary()) for x in (np.stack(own).astype(np.uint8), b.column(2).to_numpy(), *roles))
            listed = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(i)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([first, others[0], *listed, *others[1:]], names)

    dealt = made.repartition(max(2 * cores, rows.count() >> 19))
    return stage(dealt.mapInArrow(pack, schema), "fit-blocks"), [*(len(x) + 1 for x in cuts), len(kinds)]


def fit_and_score(
    rows: DataFrame, fits: Sequence[Fit], category: str = "content_type", key: str = "row_id", group: str = "group", trees: int = 10, share: float = 0.8, seed: int = 42,
    step: float = 0.1, depth: int | None = 4, leaves: int | None = None, least_rows: int = 10, bins: int = 32, columns: float = 1.0,
) -> DataFrame:
    """(tags, key, group, label, score): the rows that each fit scores, with its label. All fits have the same tags.

    Fits are independent jobs of one task each, as many at once as there are cores; only trees reach the driver. All rows are
    then scored in one pass.
    """
    if bins > 256 or depth is None and not leaves:
        raise ValueError("at most 256 bins, and a limit of the depth or the leaves")
    sc, how = rows.sparkSession.sparkContext, Growth(trees, step, depth, leaves, least_rows, share, columns, seed)
    numeric = list(dict.fromkeys(c for f in fits for c in f.numeric))
    blocks, widths = _blocks(rows, fits, numeric, category, key, group, bins)
    used = [[*(numeric.index(c) for c in f.numeric), len(numeric)] for f in fits]
    roles, total = [f"role_{i}" for i in range(len(fits))], len(widths)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(used), TEST + 2), np.int64)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                for x in column:
                    out[i] += np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=TEST + 2)
        yield pa.RecordBatch.from_pydict({"n": pa.array([out.tobytes()], pa.binary())})

    held = sum(np.frombuffer(r["n"], np.int64).reshape(len(fits), -1) for r in blocks.select(*roles).mapInArrow(counts, "n binary").collect())
    kept = [i for i, f in enumerate(fits) if held[i, TEST:].sum() >= f.least and (not f.least or held[i, TRAIN:TEST].all())]

    def fitted(i: int) -> Forest:
        mine, n, weights, own_widths = used[i], int(held[i, TRAIN:TEST].sum()), fits[i].weights, [widths[f] for f in used[i]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def read() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
                for batch in batches:
                    for own, role, *h in zip(*batch.columns):
                        role = np.frombuffer(role.as_buffer(), np.uint8)
                        at = np.flatnonzero((role >= TRAIN) & (role < TEST))
                        b = np.frombuffer(own.as_buffer(), np.uint8).reshape(total, -1)[mine][:, at]
                        yield b, role[at] == TRAIN + 1, np.frombuffer(h[0].as_buffer(), np.uint64)[at] if h else None

            yield pa.RecordBatch.from_pydict({"forest": pa.array([pickle.dumps(grow(read(), n, own_widths, weights, how))], pa.binary())})

        light = blocks.select("bins", roles[i], *(["hashes"] if share < 1 else []))
        return pickle.loads(light.coalesce(1).mapInArrow(run, "forest binary").collect()[0]["forest"])

    with ThreadPoolExecutor(max(1, min(len(kept), sc.defaultParallelism))) as pool:
        forests = dict(zip(kept, pool.map(fitted, kept)))
    shared = sc.broadcast(forests)  # bounded by fits * trees * nodes
    tags = {k: T.StringType() if isinstance(v, str) else T.IntegerType() for k, v in fits[0].tags.items()}
    named = [f.tags for f in fits]
    schema = T.StructType(
        [*(T.StructField(k, t) for k, t in tags.items()), T.StructField(key, rows.schema[key].dataType), T.StructField(group, rows.schema[group].dataType)]
        + [T.StructField(c, T.DoubleType()) for c in ("label", "score")]
    )

    names = schema.fieldNames()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                bins = np.frombuffer(batch.column("bins")[r].as_buffer(), np.uint8).reshape(total, -1)
                keys, groups = batch.column("keys")[r].values, batch.column("groups")[r].values
                for i, forest in shared.value.items():
                    role = np.frombuffer(batch.column(roles[i])[r].as_buffer(), np.uint8)
                    mine = np.flatnonzero(role >= TEST)
                    score = 1 / (1 + np.exp(-2 * forest.margins(bins[used[i]][:, mine], step)))
                    const = [pa.repeat(pa.scalar(v, pa.string() if isinstance(v, str) else pa.int32()), len(mine)) for v in named[i].values()]
                    columns = [*const, keys.take(pa.array(mine)), groups.take(pa.array(mine)), pa.array((role[mine] - float(TEST)).astype(float)), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.mapInArrow(scored, schema)
