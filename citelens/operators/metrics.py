"""Ranking metrics of scores against 0/1 labels.

Pooled metrics first aggregate by distinct score, so that the running sums go over few rows; where a score has many distinct
values they are taken in ranges (``ranges.running``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelens.operators.ranges import _cuts, _place, quantiles, running
from citelens.operators.relational import position_in_group, top_k
from citelens.operators.validation import times_drawn
from citelens.staging import stage

def _by_score(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).alias("s"))
        .agg(F.sum(label).cast("bigint").alias("tp"), F.count("*").alias("n"))
    )


def running_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, s, tp, n, cum_tp, cum_n, positives, total): of each distinct score, counts at it and at or above it."""
    return _running(_by_score(df, score, label, by), by)


def _running(grouped: DataFrame, by: Sequence[str]) -> DataFrame:
    placed = running(grouped, "s", ["tp", "n"], by, descending=True)
    return placed.withColumnsRenamed({"all_tp": "positives", "all_n": "total"})


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, ap, positives, total): step average precision over distinct thresholds; NULL without positives."""
    counts = running_counts(df, score, label, by)
    step = F.col("tp") / F.nullif(F.col("positives"), F.lit(0)) * F.col("cum_tp") / F.col("cum_n")
    return counts.groupBy(*by).agg(F.sum(step).alias("ap"), F.max("positives").alias("positives"), F.max("total").alias("total"))


#: Rows whose draws are worked out at once; memory is this times the replicates.
_BLOCK = 1024


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(model, cell, hashes, scores, counts 2 x rows) of stretches of rows of one model and cell."""
    for batch in batches:
        model = batch.column(0).dictionary_encode()
        codes, names = model.indices.to_numpy(zero_copy_only=False), model.dictionary.to_pylist()
        cell, h, s, tp, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
        changes = np.flatnonzero((codes[1:] != codes[:-1]) | (cell[1:] != cell[:-1])) + 1
        edges = np.unique(np.concatenate([changes, np.arange(0, len(cell), _BLOCK), [len(cell)]]))
        for i, j in zip(edges[:-1], edges[1:]):
            yield names[codes[i]], int(cell[i]), h[i:j], s[i:j], np.stack([tp[i:j], n[i:j]]).astype(float)


def resampled_ap(df: DataFrame, group: str, score: str, label: str, by: str, replicates: int, seed: int) -> DataFrame:
    """(by, rep, ap): average precision of each model in ``by`` over resamples of the groups, as ``bootstrap_counts`` draws them.

    Rows are sorted in ranges of the score, and how often a row is drawn follows from its group's hash, for a block of rows at
    a time: no table of groups or scores times replicates is ever made. The first pass adds up each range, which gives
    the sums before it (ranges x replicates on the driver), the second goes over the thresholds.
    """
    known = df.where(F.col(group).isNotNull() & F.col(by).isNotNull() & F.col(score).isNotNull() & F.col(label).isNotNull())
    counted = known.groupBy(F.col(by).alias("model"), F.xxhash64(group).alias("h"), F.col(score).cast("double").alias("s")).agg(
        F.sum(label).cast("bigint").alias("tp"), F.count("*").alias("n")
    )
    counted = stage(counted, "resampled-counts")
    cuts = _cuts(counted, "s")
    celled = counted.select("model", (-_place(F.col("s"), cuts, 0)).alias("cell"), "h", "s", "tp", "n")
    placed = celled.repartition(len(cuts) + 1, "model", "cell").sortWithinPartitions("model", "cell", F.desc("s"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for model, cell, h, _, counts in _stretches(batches):
            sums[model, cell] = sums.get((model, cell), 0) + counts @ times_drawn(h, replicates, seed).astype(float)
        rows = [{"model": m, "cell": c, "sums": x.tobytes()} for (m, c), x in sums.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("model", pa.string()), ("cell", pa.int32()), ("sums", pa.binary())]))

    before: dict[tuple, np.ndarray] = {}
    whole: dict[str, np.ndarray] = {}
    for row in sorted(placed.mapInArrow(totals, "model string, cell int, sums binary").collect(), key=lambda r: (r["model"], r["cell"])):
        own = whole.get(row["model"], np.zeros((2, replicates)))
        before[row["model"], row["cell"]] = own
        whole[row["model"]] = own + np.frombuffer(row["sums"]).reshape(2, replicates)
    shared = df.sparkSession.sparkContext.broadcast((before, whole))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, whole = shared.value
        at, held, last = None, None, None  # the model and cell, the sums of the score that may go on, that score

        def add(runs: np.ndarray) -> None:
            nonlocal upto, ap
            c = upto[:, None, :] + np.cumsum(runs, axis=1)
            ap += (runs[0] * np.divide(c[0], c[1], out=np.zeros_like(c[0]), where=c[1] > 0)).sum(0)
            upto = c[:, -1]

        def ended() -> pa.RecordBatch:
            add(held[:, None, :])
            positives = whole[at[0]][0]
            part = [a / p if p else None for a, p in zip(ap, positives)]
            columns = [pa.array([at[0]] * replicates), pa.array(range(replicates), pa.int32()), pa.array(part, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["model", "rep", "part"])

        upto = ap = np.zeros(0)
        for model, cell, h, s, counts in _stretches(batches):
            if at != (model, cell):
                if at:
                    yield ended()
                at, held, last, upto, ap = (model, cell), None, None, before[model, cell], np.zeros(replicates)
            differ = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
            starts = np.concatenate([[0], np.flatnonzero(differ) + 1])
            runs = np.add.reduceat(counts[:, :, None] * times_drawn(h, replicates, seed), starts, axis=1)
            if held is not None and (s[0] == last or np.isnan(s[0]) and np.isnan(last)):
                runs[:, 0] += held
            elif held is not None:
                add(held[:, None, :])
            if len(starts) > 1:
                add(runs[:, :-1])
            held, last = runs[:, -1].copy(), s[-1]
        if at:
            yield ended()

    parts = placed.mapInArrow(steps, "model string, rep int, part double")
    return parts.groupBy(F.col("model").alias(by), "rep").agg(F.sum("part").alias("ap"))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc): tie-corrected; NULL unless both classes are there."""
    c = running_counts(df, score, label, by)
    # pairs won by the positives of each score against all lower scores, and half of those at it
    fp, cum_fp = F.col("n") - F.col("tp"), F.col("cum_n") - F.col("cum_tp")
    negatives = F.col("total") - F.col("positives")
    won = F.col("tp") * ((negatives - cum_fp) + fp / 2)
    return c.groupBy(*by).agg((F.sum(won) / F.nullif(F.max(F.col("positives") * negatives), F.lit(0))).alias("auc"))


def per_query_ap(df: DataFrame, score: str, label: str, query: str) -> DataFrame:
    """(mean_ap, queries): over the queries that have both classes."""
    each = average_precision(df, score, label, [query]).where("positives > 0 and positives < total")
    return each.agg(F.avg("ap").alias("mean_ap"), F.count("*").alias("queries"))


def _sizes(df: DataFrame, label: str, query: str) -> DataFrame:
    return df.groupBy(query).agg(F.sum(label).alias("k"), F.count("*").alias("n")).where("k > 0")


def precision_at_k(df: DataFrame, label: str, query: str, order: Sequence[Column], k: int) -> DataFrame:
    """(hits, places, precision): summed over the queries with k rows or more and a positive."""
    top = top_k(df, [query], order, k).join(_sizes(df, label, query), query).where(F.col("n") >= k)
    return top.agg(F.sum(label).alias("hits"), F.count("*").alias("places"), F.avg(label).alias("precision"))


def precision_at_true_k(df: DataFrame, label: str, query: str, order: Sequence[Column]) -> DataFrame:
    """(precision, queries): mean over the queries of the hits among their first k, where k is their positives."""
    placed = position_in_group(df, [query], order, "_r").join(_sizes(df, label, query), query)
    each = placed.where(F.col("_r") < F.col("k")).groupBy(query).agg(F.avg(label).alias("p"))
    return each.agg(F.avg("p").alias("precision"), F.count("*").alias("queries"))


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, f1): the smallest threshold with the best F1."""
    c = running_counts(df, score, label)
    f1 = 2 * F.col("cum_tp") / (F.col("positives") + F.col("cum_n"))
    return c.select("s", F.round(f1, 12).alias("f1")).agg(
        F.max_by("s", F.struct("f1", -F.col("s"))).alias("threshold"), F.max("f1").alias("f1")
    )


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """(label, predicted, n)."""
    predicted = (F.col(score) >= threshold).cast("int")
    return df.groupBy(F.col(label).alias("label"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, mean_label, gap): equal-frequency bins, in which ties share a bin; only bins with rows."""
    edges = quantiles(df, score, [i / bins for i in range(1, bins)]).select(F.col("q").alias("edges"))
    scored = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(edges))
    bin_ = F.size(F.filter("edges", lambda e: e < F.col(score)))
    return (
        scored.groupBy(bin_.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label"))
        .withColumn("gap", F.abs(F.col("mean_score") - F.col("mean_label")))
    )
