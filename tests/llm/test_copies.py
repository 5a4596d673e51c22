from collections import defaultdict

import pytest

from citelens.llm import copies

CANDIDATES = "row_id bigint, query_id string, query string, url string, organic_rank int, domain string"
LABELS = "row_id bigint, query_id string, query string, url string, is_ranked boolean, label int, expected int, key string"


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("https://www.a.test/x", "http://A.TEST/x/", True),
        ("https://a.test//x///y/", "a.test/x/y", True),
        ("https://a.test/x?b=1&a=2", "https://a.test/x/?a=2&b=1", True),
        ("https://a.test/x?a=B", "https://a.test/x?a=b", False),
        ("https://a.test/X", "https://a.test/x", False),
        ("https://a.test/m%C3%BCll", "<https://a.test/müll>.", True),
        ("[a.test](https://a.test/x)", " (https://a.test/x);/.", True),
        ("([a.test](https://a.test/x))", "[a.test]([a.test](https://a.test/x)).", True),
        ("„https://a.test/x“,", " https://a.test/x\n", True),
        ("https://a.test/x_(y)", "https://a.test/x_(y", False),
        ("https://m.a.test/x", "https://a.test/x", False),
        ("https://a.test/%ff", "https://a.test/%FE", False),
    ],
)
def test_canonical_url(a, b, same):
    assert (copies.canonical_url(a) == copies.canonical_url(b)) is same


def test_long_wrappings():
    import time

    began = time.time()
    for url in (")" * 300_000, "(" * 300_000, "/" * 300_000, "https://a.test/" + "x/)." * 100_000, "[a](" * 300 + "b.test/" + ")" * 300, "[" * 200_000):
        copies.canonical_url(url)
    assert time.time() - began < 20


def test_canonical_empty():
    assert copies.canonical_url(None) is None
    assert copies.canonical_url("") is None
    assert copies.canonical_url(" <> . ") is None
    assert copies.canonical_query(None) is None
    assert copies.canonical_query(" „ÜBER-uns“ 2 ") == "über uns 2"


def test_copies_with_nulls_and_ties(spark):
    cand = spark.createDataFrame(
        [
            (1, "q", "Haus Wert", "https://a.test/x", 1, None),
            (5, "q", "haus-wert?", "(http://www.a.test/x/)", 1, "A"),
            (3, "q", "haus wert", "https://a.test/x", 2, None),
            (4, None, "haus wert", "https://a.test/x", 1, None),
            (6, "q", "haus wert", None, 1, None),
            (7, "q", "haus wert", "", 1, None),
            (8, "q", None, "https://a.test/x", None, None),
            (9, "q", None, "a.test/x", None, None),
            (1, "q", "Haus Wert", "https://a.test/x", 1, None),
        ],
        CANDIDATES,
    )
    labels = spark.createDataFrame(
        [(1, "q", "a", "https://a.test/", True, 1, None, "z"), (2, "q", "A", "a.test", True, 1, None, "y")], LABELS
    )
    got = sorted(map(tuple, copies.copies(cand, labels).collect()))
    assert got == [("candidates", 1, 5), ("candidates", 8, 9), ("label_validation", 1, 2)]
    counts = {tuple(x)[:2]: x["copies"] for x in copies.collapsed(cand, labels).collect()}
    assert counts[("candidates", 1)] == 3 and counts[("candidates", 4)] == 1 and counts[("candidates", 8)] == 2


def test_empty_tables(spark):
    cand, labels = spark.createDataFrame([], CANDIDATES), spark.createDataFrame([], LABELS)
    assert copies.copies(cand, labels).count() == 0
    assert copies.collapsed(cand, labels).count() == 0


def test_a_class_across_ranges(spark):
    """A key that a third of the rows have is cut into several ranges and mended."""
    rows = [("t", i, "hot" if i % 3 == 0 else f"k{i % 1000}") for i in range(20000, 0, -1)]
    expected = defaultdict(list)
    for _, i, k in rows:
        expected[k].append(i)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "table_name string, row_id bigint, key string").repartition(5)
        got = {x["row_id"]: x["first_id"] for x in copies.classes(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: min(ids) for ids in expected.values() for i in ids}
