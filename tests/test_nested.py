"""Problem 2 against a plain walk."""

import json

import pytest

from citelens.operators import json_text
from citelens.operators.nested import flat_table, object_nodes

ROWS = "id bigint, body string, node string, parent string"


def walk(value, path="", parent=""):
    if isinstance(value, dict):
        for k, x in value.items():
            yield from walk(x, f"{path}.{k}" if path else k, parent)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            here = f"{path}[{i}]"
            if isinstance(x, dict):
                yield here, parent
                yield from walk(x, here, here)
            else:
                yield from walk(x, here, parent)


BODIES = [
    '{"a":[{},null,{"b":[[{"c":1}]],"o":{"p":[{"q":2}]}}],"n":[1,"x",[]]}',
    '[{"a":[{"b":[{"c":[{"d":[{"e":[{"f":[{}]}]}]}]}]}]}]',
    '{"x y.z":[{"k":[{}]}], "ü":[{"€":[{}]}]}',
    "[" * 40 + '{"a":[{}]}' + "]" * 40,
    '{"s":"[{}] not json {\\"a\\":[{}]}"}',
    "{}", "[]", "5", "null", '"text"',
]
BROKEN = [None, "", " ", "{", '{"a":[{}]} x', '{"a":[{}]}]', '[{}] [{}]', '[{}],[{}]', "[{}]] [1", "<html>", '{"a":[{},]}', "{'a':[{}]}"]


def test_nodes_against_a_walk(spark):
    rows = [(i, b, None, "clash") for i, b in enumerate(BODIES + BROKEN)] + [(0, BODIES[0], None, "clash")]
    got = sorted(tuple(r) for r in object_nodes(spark.createDataFrame(rows, ROWS), "id", "body").collect())
    expected = [(i, *n) for i, b in enumerate(BODIES) for n in walk(json.loads(b))]
    assert got == sorted(expected + [(0, *n) for n in walk(json.loads(BODIES[0]))])


@pytest.mark.parametrize("body", BODIES)
def test_reading_without_recursion(body):
    root = json_text.parse(body)
    assert sorted(x[:2] for x in json_text.object_elements(root)) == sorted(walk(json.loads(body)))


@pytest.mark.parametrize("body", [b for b in BROKEN if b is not None] + ["01", "1.", "-", "+1", "[1,]", '{"a"}', '{"a":}', '{"a":1,}', '"\n"', '"\\x"', "tru", "nul", "[1 2]", "]", ",", '{1:2}', "[1}", "NaN"])
def test_invalid_json(body):
    assert json_text.parse(body) is None


def test_beyond_the_parser(spark):
    deep, depth = '{"b":1}', 600
    for _ in range(depth):
        deep = '{"a":[' + deep + "]}"
    bodies = [deep, '{"a":[{"n":' + "7" * 1200 + ',"m":5}]}', '{"a":[{"s":"' + "x" * (25 << 20) + '","c":[{}]}]}', '{"a":[{"n":' + "7" * 1200 + "}]} x", '{"a":[{}],"a":[{"n":' + "7" * 1200 + "},{}]}"]
    df = spark.createDataFrame([(i, b, None, "clash") for i, b in enumerate(bodies)], ROWS)
    counts = {r["id"]: r["count"] for r in object_nodes(df, "id", "body").groupBy("id").count().collect()}
    assert counts == {0: depth, 1: 1, 2: 2, 4: 2}
    nodes = object_nodes(df.where("id in (1, 2)"), "id", "body", True)
    got = {r["id"]: r for r in flat_table(nodes, "id", "a", {"n": "string", "m": "int", "s": "string"}).selectExpr("id", "n", "m", "length(s) as s").collect()}
    assert got[1]["n"] == "7" * 1200 and got[1]["m"] == 5 and got[2]["s"] == 25 << 20
    assert flat_table(nodes, "id", "c", {"n": "int"}).collect()[0]["parent"] == "a[0]"


def test_repeated_names_and_long_bodies(spark):
    many = json.dumps({"a": [{"i": i, "b": [{}]} for i in range(5000)]})
    rows = [(1, '{"a":[{}],"a":[{},{}]}', None, None), (2, many, None, None)]
    got = object_nodes(spark.createDataFrame(rows, ROWS), "id", "body")
    assert got.where("id = 1").count() == 2 and got.where("id = 2").count() == 10_000


def test_flat_table(spark):
    body = '{"items":[{"type":"a","rank":"3","items":["x",{"type":"b","rank":4}]},{"type":5,"rank":"no"}]}'
    nodes = object_nodes(spark.createDataFrame([(1, body, None, None)], ROWS), "id", "body", True)
    got = {r["node"]: r for r in flat_table(nodes, "id", "items", {"type": "string", "rank": "int"}).collect()}
    assert got["items[0]"]["rank"] == 3 and got["items[0].items[1]"]["rank"] == 4 and got["items[0].items[1]"]["parent"] == "items[0]"
    assert got["items[1]"]["rank"] is None and got["items[1]"]["type"] == "5" and got["items[1]"]["position"] == 1


def test_empty(spark):
    assert object_nodes(spark.createDataFrame([], ROWS), "id", "body").count() == 0
