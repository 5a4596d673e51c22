"""Time windows over timed snippets and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelens.functions.text import content_words

_WINDOW = "array<struct<start:double,text:string>>"


def tumbling_windows(snippets: Column, seconds: float = 30.0) -> Column:
    """Windows of an ordered array<struct<start, text>>, each from a snippet's time on.

    A snippet that begins ``seconds`` or more after the window's start still belongs to it and closes it; the next window
    starts at that snippet's time. What is left at the end is a window too.
    """
    state = F.struct(
        F.array().cast(_WINDOW).alias("done"),
        F.array().cast("array<string>").alias("open"),
        F.coalesce(F.get(snippets, 0)["start"], F.lit(0.0)).alias("since"),
    )

    def step(s: Column, x: Column) -> Column:
        held = F.concat(s["open"], F.array(F.coalesce(x["text"], F.lit(""))))
        at = F.coalesce(x["start"], F.lit(0.0))
        closes = at - s["since"] >= seconds
        window = F.struct(s["since"].alias("start"), F.array_join(held, " ").alias("text"))
        return F.struct(
            F.when(closes, F.concat(s["done"], F.array(window))).otherwise(s["done"]).alias("done"),
            F.when(closes, F.array().cast("array<string>")).otherwise(held).alias("open"),
            F.when(closes, at).otherwise(s["since"]).alias("since"),
        )

    def finish(s: Column) -> Column:
        last = F.struct(s["since"].alias("start"), F.array_join(s["open"], " ").alias("text"))
        return F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(last))).otherwise(s["done"])

    return F.aggregate(snippets, state, step, finish)


def sliding_windows(df: DataFrame, key: str, snippets: str, length: float = 45.0, step: float = 15.0) -> DataFrame:
    """(key, start, text): windows of ``length`` every ``step`` from 0 to the last snippet's time; blank ones are dropped.

    Each snippet goes to the windows that hold its time, at most length/step of them: no range join.
    """
    each = df.select(key, F.posexplode(snippets).alias("pos", "s")).select(
        key, "pos", F.col("s.start").alias("t"), F.coalesce("s.text", F.lit("")).alias("text")
    )
    first = F.greatest(F.lit(0), F.floor((F.col("t") - length) / step) + 1).cast("int")
    held = each.where("t >= 0").withColumn("w", F.explode(F.sequence(first, F.floor(F.col("t") / step).cast("int"))))
    joined = held.groupBy(key, "w").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text")
    )
    return joined.where(F.trim("text") != "").select(key, (F.col("w") * step).alias("start"), "text")


def best_window(windows: DataFrame, key: str, target: DataFrame, words: str) -> DataFrame:
    """(key, best_start, score): the window with most of the target's content words, over the root of its own count.

    ``target`` has (key, words array<string>); ties go to the earliest; without a common word: start 0 and score 0.
    """
    scored = windows.join(target, key).withColumn("own", content_words(F.col("text")))
    common = F.size(F.array_intersect("own", words))
    score = F.when(common > 0, common / F.sqrt(F.size("own"))).otherwise(0.0)
    best = scored.groupBy(key).agg(F.max(F.struct(F.round(score, 12).alias("score"), (-F.col("start")).alias("neg"))).alias("b"))
    start = F.when(F.col("b.score") > 0, -F.col("b.neg")).otherwise(0.0)
    return best.select(key, start.alias("best_start"), F.col("b.score").alias("score"))


def contained(df: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, cell: float) -> DataFrame:
    """Rows of ``df`` with each span of their key that holds their time, start <= at < end.

    Spans are spread over cells of fixed width, so that the join is on (key, cell) and the range is only checked within.
    """
    celled = spans.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell)))
    )
    rows = df.withColumn("_cell", F.floor(F.col(at) / cell))
    return rows.join(celled, [key, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")
