"""Problem 4 against union-find."""

import random

from citelens.llm import group_split

LABELS = "row_id bigint, query_id string, url string, label int, site string, set_domain string, split_name string"


def brute(rows):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    def site(url):
        return url.split("/")[2].lower().removeprefix("www.") if url else None

    for i, q, url, *_ in rows:
        for other in (("q", q) if q is not None else None, ("s", site(url)) if site(url) else None):
            if other:
                root[find(("r", i))] = find(other)
    least = {}
    for i, _, url, *_ in rows:
        if site(url):
            k = find(("r", i))
            least[k] = min(least.get(k, site(url)), site(url))
    return {(i, least.get(find(("r", i)))) for i, *_ in rows}


def row(i, q, url, label=0):
    return (i, q, url, label, "clash", "clash", "clash")


def fixture():
    r = random.Random(2)
    rows = [row(i, f"q{r.randrange(80)}", f"https://{r.choice(['', 'www.'])}s{r.randrange(120)}.test/x", r.randrange(2)) for i in range(150)]
    chain = [row(1000 + i, f"c{i // 2}", f"http://Z{(i + 1) // 2:03d}.test/") for i in range(200)]  # one long chain
    hot = [row(2000 + i, "hot", f"https://h{i % 5}.test/") for i in range(150)]
    odd = [row(3000, None, None), row(3001, "alone", None), row(3002, "alone", ""), row(3003, None, "https://s1.test/"), row(3004, "q1", None, None)]
    return rows + chain + hot + odd


def test_tied_sets(spark):
    rows = fixture()
    got = group_split.tied_sets(spark.createDataFrame(rows, LABELS)).select("row_id", "set_domain").collect()
    assert len(got) == len(rows) and {tuple(x) for x in got} == brute(rows)


def test_splits_keep_sets_and_shares(spark):
    rows = fixture() + [row(10_000 + i, f"solo{i}", f"https://solo{i}.test/", i % 2) for i in range(1500)]
    df = spark.createDataFrame(rows, LABELS)
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, split_share double")
    for exact in (5000, 20):
        made = {x["row_id"]: x for x in group_split.grouped_splits(df, shares, exact).collect()}
        assert len(made) == len(rows)
        of_query, of_set = {}, {}
        for i, q, *_ in rows:
            if q is not None:
                assert of_query.setdefault(q, made[i]["split_name"]) == made[i]["split_name"]
            if made[i]["set_domain"]:
                assert of_set.setdefault(made[i]["set_domain"], made[i]["split_name"]) == made[i]["split_name"]
        train = sum(x["split_name"] == "train" for x in made.values()) / len(rows)
        assert abs(train - 0.8) < (0.01 if exact == 5000 else 0.05)


def test_small_sets_make_up_for_a_hot_one(spark):
    """A third of the rows in one set of other label mix: every split still gets its rows and the labels of the whole."""
    r = random.Random(6)
    rows = [row(i, "hot", f"https://hot{i % 7}.test/", int(i % 10 < 9)) for i in range(1000)]
    for k in range(900):
        rows += [row(len(rows) + j, f"q{k}", f"https://tail{k}.test/", int(r.random() < 0.2)) for j in range(r.choice([1, 1, 2, 3, 4]))]
    rows += [row(len(rows), None, None, None), row(None, None, None, 1), row(None, "q1", None, 0)]
    df = spark.createDataFrame(rows, LABELS)
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, split_share double")
    label = {x[0]: x[3] for x in rows}
    rate = sum(x[3] or 0 for x in rows) / len(rows)
    splits = []
    for exact, per_bucket in ((5000, 200_000), (20, 200_000), (20, 50)):
        made = group_split.grouped_splits(df, shares, exact, sets_per_bucket=per_bucket).collect()
        assert len(made) == len(rows)
        for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
            ids = [x["row_id"] for x in made if x["split_name"] == name]
            assert abs(len(ids) - share * len(rows)) < 4
            assert abs(sum(label[i] or 0 for i in ids) / len(ids) - rate) < 0.01
        splits.append({(x["row_id"], x["split_name"]) for x in made})
    assert splits[0] == splits[1]


def test_counts_of_many_equal_sets():
    profiles = [dict(n=3, positive=3, negative=0, sets=1_000_003), dict(n=1, positive=0, negative=1, sets=9_000_001)]
    total = {x: sum(g[x] * g["sets"] for g in profiles) for x in ("n", "positive", "negative")}
    shares = {"a": 0.1, "b": 0.1, "c": 0.8}
    dealt = group_split._greedy(profiles, total, shares)
    for g in profiles:
        counts = dealt[g["n"], g["positive"], g["negative"]]
        assert sum(counts) == g["sets"] and all(abs(c - s * g["sets"]) < 0.001 * g["sets"] for c, s in zip(counts, shares.values()))


def test_empty_and_repeated(spark):
    shares = spark.createDataFrame([("a", 1.0), ("b", 0.0), (None, 1.0)], "split_name string, split_share double")
    empty = spark.createDataFrame([], LABELS)
    assert group_split.tied_sets(empty).count() == 0
    assert group_split.grouped_splits(empty, shares).count() == 0
    twice = spark.createDataFrame([row(1, "q", "https://a.test/"), row(1, "q", "https://a.test/")], LABELS)
    assert [tuple(x) for x in group_split.grouped_splits(twice, shares).collect()] == [(1, "a.test", "a")] * 2
