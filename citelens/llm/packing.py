"""Problem 8: documents in containers of fixed capacity.

Variable-capacity best-fit. What is packed are sizes, not rows: the number of items of each size (at most ``capacity``
different ones) goes to the driver, where best-fit decreasing is run on counts. Equal containers are kept as one group with a
count, so that the work depends on the number of sizes and not of items. A new container gets the permitted capacity that the
items at hand fill at the least unused room; in the end each container is downsized to the smallest permitted capacity that
holds its contents. The groups say, for each size, which ranks of its items go to which containers; every item finds
its place by its rank among the items of its size.

Scale. Only the histogram and the plan (bounded by the capacity, whatever the data) pass through the driver. Ranks come from
counts by (bucket, size) and a row number within those; the number of buckets follows the rows, so that a size that a third
of all items share is spread over as many as it needs.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelens.llm.tokenize import VOCABULARIES, encoded
from citelens.staging import stage

_SLOTS = "size int, from_rank bigint, to_rank bigint, per_container bigint, first_container bigint, start int, container_size int"


@dataclass
class Group:
    """``count`` containers with the same contents: (size, how many), in the order they were put in."""

    count: int
    capacity: int
    room: int
    contents: tuple[tuple[int, int], ...]


def best_fit(histogram: dict[int, int], capacities: list[int]) -> list[Group]:
    """Groups of containers that hold all items; no size may exceed the largest capacity."""
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []  # those of by_room, in rising order
    closed: list[Group] = []

    def keep(group: Group) -> None:
        if not group.count:
            return
        if not group.room:
            closed.append(group)
        elif group.room in by_room:
            by_room[group.room].append(group)
        else:
            by_room[group.room] = [group]
            insort(rooms, group.room)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):  # the fitting room that is nearest
                same = by_room[rooms[at]]
                group = same.pop()
                if not same:
                    del by_room[rooms.pop(at)]
            else:
                unused = {c: (c - min(c // size, left) * size) / c for c in capacities if c >= size}
                best = min(unused, key=lambda c: (unused[c], -c)) if len(unused) > 1 else next(iter(unused))
                group = Group(-(-left // (best // size)), best, best, ())
            each = group.room // size
            full = min(group.count, left // each)
            rest = min(left - full * each, each - 1) if full < group.count else 0
            for count, n in ((full, each), (1 if rest else 0, rest)):
                keep(Group(count, group.capacity, group.room - n * size, (*group.contents, (size, n))))
                left -= count * n
                group.count -= count
            if group.contents:  # containers that this size doesn't need any more
                keep(group)
    return closed + [g for groups in by_room.values() for g in groups]


def plan(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows of _SLOTS: the ranks of each size in each group of containers."""
    used: dict[int, int] = defaultdict(int)
    slots, number = [], 0
    for group in best_fit(histogram, capacities):
        inside = sum(size * n for size, n in group.contents)
        final = min(c for c in capacities if c >= inside)
        start = 0
        for size, n in group.contents:
            slots.append((size, used[size], used[size] + group.count * n, n, number, start, final))
            used[size] += group.count * n
            start += size * n
        number += group.count
    return slots


def pack(items: DataFrame, capacities: list[int], rows_per_bucket: int = 200_000) -> DataFrame:
    """(key, part, tokens, cut_from, container, position, container_size) from (key, tokens).

    An item larger than the largest capacity is cut into full parts and a rest; ``cut_from`` is where the part begins in its
    item. No other item is cut. Items without tokens come out with a null container. Null tokens count as none.
    """
    spark = items.sparkSession
    capacities = sorted({c for c in capacities if c and c > 0})
    if not capacities:
        raise ValueError("no capacity is positive")
    most = capacities[-1]
    size = F.coalesce(F.col("tokens"), F.lit(0))
    parts = items.select(
        "key",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.ceil(size / most) - 1, F.lit(0)).cast("int")),
                lambda i: F.least(size - i * most, F.lit(most)).cast("int"),
            )
        ).alias("part", "tokens"),
    )
    parts = stage(parts, "pack-parts")
    full = parts.where("tokens > 0")
    rows = full.count()
    buckets = max(1, -(-rows // rows_per_bucket))
    bucketed = full.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)).cast("int"))
    counts = stage(bucketed.groupBy("tokens", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {x["tokens"]: x["n"] for x in counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = spark.createDataFrame(plan(histogram, capacities), _SLOTS)
    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("tokens", "bucket").orderBy("key", "part")
    ranked = (
        bucketed.withColumn("row", F.row_number().over(within))
        .join(offsets, ["tokens", "bucket"])
        .withColumn("rank", F.col("offset") + F.col("row") - 1)
    )
    s, r = F.broadcast(slots).alias("s"), ranked.alias("r")
    placed = r.join(
        s, (F.col("r.tokens") == F.col("s.size")) & (F.col("r.rank") >= F.col("s.from_rank")) & (F.col("r.rank") < F.col("s.to_rank"))
    )
    at = F.col("r.rank") - F.col("s.from_rank")
    out = placed.select(
        "r.key",
        "r.part",
        "r.tokens",
        (F.col("r.part") * most).alias("cut_from"),
        (F.col("s.first_container") + (at - F.pmod(at, "s.per_container")) / F.col("s.per_container")).cast("bigint").alias("container"),
        (F.col("s.start") + F.pmod(at, "s.per_container") * F.col("r.tokens")).cast("int").alias("position"),
        "s.container_size",
    )
    empty = parts.where("tokens <= 0").select(
        "key", "part", F.lit(0).alias("tokens"), F.lit(0).alias("cut_from"),
        F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("container_size"),
    )
    return out.unionByName(empty)


def packed_documents(documents: DataFrame, limits: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, part, tokens, cut_from, container, position, container_size) of every document.

    The capacities are those of the first tokenizer, by name, in ``limits``. Repeated documents are packed each by itself.
    """
    wanted = limits.where("tokenizer is not null").select("tokenizer", "capacity").distinct().collect()  # a fixed table
    name = min(x["tokenizer"] for x in wanted)
    sizes = encoded(documents, "doc_id", "text", name, folder).select(
        F.col("doc_id").alias("key"), F.size("ids").alias("tokens")
    )
    made = pack(sizes, [x["capacity"] for x in wanted if x["tokenizer"] == name])
    return made.withColumnRenamed("key", "doc_id")


def packing_report(documents: DataFrame, limits: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """(containers, tokens, capacity, least_containers, fill): the least number is the sum of tokens over the capacity."""
    made = packed_documents(documents, limits, folder).where("container is not null")
    each = made.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.max("container_size").alias("size"))
    most = limits.agg(F.max("capacity")).first()[0]
    summed = each.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("size").alias("capacity"))
    return summed.select(
        "containers",
        "tokens",
        "capacity",
        F.ceil(F.col("tokens") / most).alias("least_containers"),
        (F.col("tokens") / F.nullif(F.col("capacity"), F.lit(0))).alias("fill"),
    )
