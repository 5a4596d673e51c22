"""Similarity of texts and vectors: shared n-grams, TF-IDF cosine, longest common runs, nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from citelens.functions import text as T


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(text, key, copies): the smallest key stands for all rows with the same text."""
    return df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def shared_ngrams(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int = 8) -> DataFrame:
    """(left_key, right_key, shared): pairs of distinct texts with a common run of n tokens, and how many they share.

    Both sides have (key, text). The join is on the n-gram's hash and the n-gram itself; equal texts are one row each, so that
    copies are never expanded into pairs; a hot n-gram is split by adaptive execution.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        split = df.select(key, T.tokens(F.col("text")).alias("tokens"))  # a column of its own: worked out once
        return split.select(key, F.explode(T.ngrams(F.col("tokens"), n)).alias("gram"))

    joined = grams(left, left_key).join(grams(right, right_key), "gram")
    return joined.groupBy(left_key, right_key).agg(F.count("*").alias("shared"))


def first_match(pairs: DataFrame, left_key: str, order: Sequence[str]) -> DataFrame:
    """Only the first right side of each left one."""
    w = Window.partitionBy(left_key).orderBy(*order)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


@F.pandas_udf(IntegerType())
def longest_common_run(a, b):
    """Length of the longest run of consecutive words that two token lists share; None if either is None."""
    import pandas as pd

    def one(x, y) -> int | None:
        if x is None or y is None:
            return None
        best, row = 0, {}
        places: dict[str, list[int]] = {}
        for j, w in enumerate(y):
            places.setdefault(w, []).append(j)
        for w in x:
            row = {j: row.get(j - 1, 0) + 1 for j in places.get(w, ())}
            if row:
                best = max(best, max(row.values()))
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


def tfidf(df: DataFrame, key: Sequence[str], tokens: str) -> DataFrame:
    """(key, term, w): tf times ln((1 + n) / (1 + df)) + 1, scaled to length 1 in each text."""
    terms = df.select(*key, F.explode(tokens).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n_texts"))
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    idf = idf.select("term", (F.log((1 + F.col("n_texts")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = terms.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, list(key)).select(*key, "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, scope: Sequence[str], threshold: float
) -> DataFrame:
    """(scope, left_key, right_key, cosine): the pairs of one scope whose cosine is at least ``threshold``, none lost.

    Both sides are weights (scope, key, term, w) of length 1. A text's most frequent terms are left out of the search while
    their own length stays below the threshold: without a shared term among the others a pair can't reach it. Frequent words
    therefore never bring pairs together; full products are only made for what the rarer terms found.
    """
    frequency = right.groupBy("term").agg(F.count("*").alias("_df"))
    common_first = Window.partitionBy(*scope, left_key).orderBy(F.desc("_df"), "term")
    upto = F.sum(F.col("w") * F.col("w")).over(common_first.rowsBetween(Window.unboundedPreceding, 0))
    searched = left.join(frequency, "term").withColumn("_upto", upto).where(F.col("_upto") >= threshold * threshold - 1e-6)
    found = (
        searched.select(*scope, left_key, "term").join(right.select(*scope, right_key, "term"), [*scope, "term"])
        .select(*scope, left_key, right_key)
        .distinct()
    )
    products = found.join(left.withColumnRenamed("w", "_a"), [*scope, left_key]).join(
        right.withColumnRenamed("w", "_b"), [*scope, right_key, "term"]
    )
    dots = products.groupBy(*scope, left_key, right_key).agg(F.round(F.sum(F.col("_a") * F.col("_b")), 9).alias("cosine"))
    return dots.where(F.col("cosine") >= threshold)


def _packed(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(name_ids, name_data): unit vectors, one row an Arrow batch; null vectors and those of length 0 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [x for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x[1] is not None]
            if not known:
                continue
            ids, matrix = np.array([x[0] for x in known], np.int64), np.array([x[1] for x in known], np.float64)
            norms = np.linalg.norm(matrix, axis=1)
            ids, matrix = ids[norms > 0], matrix[norms > 0] / norms[norms > 0, None]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([ids.tolist()]), pa.array([matrix.tobytes()])], [f"{name}_ids", f"{name}_data"])

    return df.select(F.col(key).cast("bigint"), vector).mapInArrow(run, f"{name}_ids array<bigint>, {name}_data binary")


def nearest_vectors(
    vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 5, block: int = 2048
) -> DataFrame:
    """(query, key, similarity, position): the k rows of highest cosine for each query vector, itself left out.

    Queries are packed into blocks, the rows into Arrow batches, and every block meets every batch as one matrix product, whose
    result is cut to k for each query before it is shuffled. Blocks are distributed like any rows; the optimizer broadcasts them
    only where their measured size allows it. Null vectors and those of length 0 are left out.
    """
    n = queries.count()
    asked = _packed(queries.repartition(max(1, -(-n // block))), key, vector, "q")
    stored = _packed(vectors, key, vector, "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                ids, own = (np.array(x, np.int64) for x in (row[0], row[2]))
                q, v = (np.frombuffer(data).reshape(len(x), -1) for x, data in ((ids, row[1]), (own, row[3])))
                scores = np.round(q @ v.T, 9)
                scores[ids[:, None] == own[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, 1)
                ok = np.isfinite(best)
                columns = [np.broadcast_to(ids[:, None], best.shape)[ok], own[order][ok], best[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", key, "similarity"])

    met = asked.crossJoin(stored).select("q_ids", "q_data", "v_ids", "v_data").mapInArrow(run, f"query bigint, `{key}` bigint, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return met.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
