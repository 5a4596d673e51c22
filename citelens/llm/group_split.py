"""Problem 4: train, validation and test splits that keep related records together.

Records and the entities they name (query, site) form a bipartite graph. Minimum labels are propagated over it in rounds:
in each query that still has several labels, every label but the smallest is hooked to the smallest, pointer jumping finds
the root of each hooked label, and the roots replace the labels. A label is hooked once and vanishes, so that the edges
shrink from round to round; the rounds' roots form a forest that is resolved in the same way. A set's label is its
alphabetically first site.

Splits are then assigned to whole sets. Sets with the same numbers of rows, positives and negatives are one profile; the sets
of each profile, the largest first, go by a greedy choice to the splits whose row counts and label counts stay nearest to their
targets. Within a profile sets are dealt out by their rank. One rule holds for all sets and at every size of input.

Scale. Edges are distinct (query, site) pairs, so that hot keys are reduced before they move; a label's minimum is a
map-side aggregate; every round is written to the shared folder. Only the profiles with their counts come to the driver; where
every row has a label, N rows make about N^(2/3) of them at most. The sets of more than 1/``broadcast_sets`` of all rows, of
which there are fewer than ``broadcast_sets``, are broadcast to their rows, so that no hot set is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from citelens.functions.site import site_of
from citelens.staging import stage


def _jumped(paths: DataFrame) -> DataFrame:
    """(site, root, moved): every path is as long again as it was."""
    up = paths.select(F.col("site").alias("root"), F.col("root").alias("next"))
    return paths.join(up, "root", "left").select(
        "site", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
    )


def _forest_roots(parents: DataFrame) -> DataFrame:
    """(site, root) from (site, parent): pointer jumping, two jumps a written step, until nothing changes."""
    paths = stage(parents.select("site", F.col("parent").alias("root")), "split-roots")
    while True:
        jumped = stage(_jumped(_jumped(paths).drop("moved")), "split-roots")
        paths = jumped.select("site", "root")
        if jumped.where("moved").isEmpty():
            return paths


def site_roots(edges: DataFrame) -> DataFrame:
    """(site, root) for every site that isn't its set's first one; ``edges`` are distinct (query_id, site) pairs."""
    spark = edges.sparkSession
    edges = edges.withColumnRenamed("site", "label")
    parents = None
    while True:
        first = edges.groupBy("query_id").agg(F.min("label").alias("least"), F.max("label").alias("most"))
        first = first.where("least < most").select("query_id", "least")
        active = stage(edges.join(first, "query_id"), "split-edges")
        if active.isEmpty():
            break
        hooks = active.where("label > least").groupBy("label").agg(F.min("least").alias("parent"))
        roots = _forest_roots(hooks.withColumnRenamed("label", "site"))
        parents = roots if parents is None else parents.unionByName(roots)
        edges = (
            active.select("query_id", "label")
            .join(roots.withColumnRenamed("site", "label"), "label", "left")
            .select("query_id", F.coalesce("root", "label").alias("label"))
            .distinct()
        )
    if parents is None:
        return spark.createDataFrame([], "site string, root string")
    return _forest_roots(parents.withColumnRenamed("root", "parent"))


def tied_sets(labels: DataFrame, *kept: str) -> DataFrame:
    """(row_id, query_id, site, set_domain, *kept): every row with the first site of its set.

    Rows are tied by the same non-null query_id or the same site of url, also through other rows. A row that is tied to no
    site at all has a null set_domain. Repeated rows come out as often as they come in; columns not ``kept`` are ignored.
    """
    rows = labels.select("row_id", "query_id", site_of(F.col("url")).alias("site"), *kept)
    edges = stage(rows.where("query_id is not null and site is not null").select("query_id", "site").distinct(), "split-edges")
    roots = site_roots(edges)
    with_site = rows.where("site is not null").join(roots, "site", "left")
    with_site = with_site.select("row_id", "query_id", "site", F.coalesce("root", "site").alias("set_domain"), *kept)
    of_query = edges.groupBy("query_id").agg(F.min("site").alias("some")).join(
        roots.withColumnRenamed("site", "some"), "some", "left"
    )
    of_query = of_query.select("query_id", F.coalesce("root", "some").alias("set_domain"))
    bare = rows.where("site is null")
    without_site = bare.where("query_id is not null").join(of_query, "query_id", "left")
    columns = ["row_id", "query_id", "site", "set_domain", *kept]
    alone = bare.where("query_id is null").withColumn("set_domain", F.lit(None).cast("string"))
    return with_site.select(columns).unionByName(without_site.select(columns)).unionByName(alone.select(columns))


_PROFILE = ["n", "positive", "negative"]
#: The sets of a profile are dealt out in parts of 1/64 of those left, in the end one by one.
_PARTS = 64


def _greedy(profiles: list[Row], total: dict[str, int], shares: dict[str, float]) -> dict[tuple[int, int, int], list[int]]:
    """How many sets of each profile go to each split, in the order of ``shares``; profiles have the number of their ``sets``."""
    wants = [[share * total[x] for x in _PROFILE] for share in shares.values()]
    has = [[0.0, 0.0, 0.0] for _ in wants]
    weights = [[1 / max(1, total[x]) ** 2 / share for x in _PROFILE] for share in shares.values()]
    dealt = {}
    for profile in sorted(profiles, key=lambda g: tuple(-g[x] for x in _PROFILE)):
        one = tuple(profile[x] for x in _PROFILE)
        counts = dealt[one] = [0] * len(wants)
        left = profile["sets"]
        while left:
            part = -(-left // _PARTS)
            adds = [part * x for x in one]
            # the change of the weighted squares of has - wants
            changes = [
                sum(w * x * (x + 2 * (h - t)) for w, h, x, t in zip(weights[k], has[k], adds, wants[k])) for k in range(len(wants))
            ]
            best = changes.index(min(changes))
            counts[best] += part
            left -= part
            has[best] = [h + x for h, x in zip(has[best], adds)]
    return dealt


def _dealt_sets(groups: DataFrame, dealt: dict[tuple[int, int, int], list[int]], splits: list[str], seed: int, per_bucket: int) -> DataFrame:
    """(set_key, n, split_name): the sets of a profile by rank, in the order of a hash; ranks are counted in buckets."""
    spark = groups.sparkSession
    buckets = max(1, -(-sum(map(sum, dealt.values())) // per_bucket))
    bucketed = groups.withColumn("order", F.xxhash64("set_key", F.lit(seed)))
    bucketed = bucketed.withColumn("bucket", F.pmod("order", F.lit(buckets)).cast("int"))
    ends = [(*k, [sum(counts[: i + 1]) for i in range(len(counts))]) for k, counts in dealt.items()]
    ends = spark.createDataFrame(ends, "n bigint, positive bigint, negative bigint, ends array<bigint>")
    counted = bucketed.groupBy(*_PROFILE, "bucket").agg(F.count("*").alias("sets"))
    before = Window.partitionBy(*_PROFILE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(*_PROFILE, "bucket", F.coalesce(F.sum("sets").over(before), F.lit(0)).alias("offset")).join(ends, _PROFILE)
    within = Window.partitionBy(*_PROFILE, "bucket").orderBy("order", "set_key")
    ranked = bucketed.withColumn("at", F.row_number().over(within) - 1).join(offsets, [*_PROFILE, "bucket"])
    rank = F.col("offset") + F.col("at")
    passed = F.size(F.filter("ends", lambda end: end <= rank))
    return ranked.select("set_key", "n", F.element_at(F.array(*map(F.lit, splits)), passed + 1).alias("split_name"))


def grouped_splits(
    labels: DataFrame, shares: DataFrame, broadcast_sets: int = 5000, seed: int = 0, sets_per_bucket: int = 200_000
) -> DataFrame:
    """(row_id, set_domain, split_name): every row; no query and no site has rows in two splits.

    ``shares`` has split_name and split_share; shares are scaled to sum 1, and at least one must be positive. A null label
    counts for the rows only. An empty table gives no rows. ``broadcast_sets`` only says which sets are broadcast, not how they are
    dealt out.
    """
    wanted = {x["split_name"]: x["split_share"] for x in shares.select("split_name", "split_share").collect()}
    wanted = {k: v for k, v in wanted.items() if k is not None and v and v > 0}
    if not wanted:
        raise ValueError("no split has a positive share")
    shares_ = {k: v / sum(wanted.values()) for k, v in sorted(wanted.items())}
    key = F.coalesce(
        F.concat(F.lit("s:"), "set_domain"), F.concat(F.lit("q:"), "query_id"), F.concat(F.lit("r:"), F.col("row_id").cast("string")), F.lit("")
    )
    rows = stage(tied_sets(labels, "label").withColumn("set_key", key), "split-rows")
    tally = [F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative")]
    groups = stage(rows.groupBy("set_key").agg(*tally), "split-sets")
    profiles = groups.groupBy(*_PROFILE).agg(F.count("*").alias("sets")).collect()
    total = {x: sum(g[x] * g["sets"] for g in profiles) for x in _PROFILE}
    dealt = _greedy(profiles, total, shares_)
    sets = stage(_dealt_sets(groups, dealt, list(shares_), seed, sets_per_bucket), "split-sets")
    large = F.col("n") * broadcast_sets > total["n"]  # fewer than ``broadcast_sets`` sets
    hot, others = F.broadcast(sets.where(large).drop("n")), sets.where(~large).drop("n")
    made = rows.join(hot, "set_key").unionByName(rows.join(hot, "set_key", "left_anti").join(others, "set_key"))
    return made.select("row_id", "set_domain", "split_name")


def split_report(labels: DataFrame, shares: DataFrame) -> DataFrame:
    """(split_name, n, share, positive_rate) of the splits made."""
    made = grouped_splits(labels, shares)
    outcomes = labels.groupBy("row_id").agg(F.max("label").alias("label"))
    total = max(1, labels.count())
    counted = made.join(outcomes, "row_id").groupBy("split_name").agg(
        F.count("*").alias("n"), F.avg("label").alias("positive_rate")
    )
    return counted.select("split_name", "n", (F.col("n") / total).alias("share"), "positive_rate")
