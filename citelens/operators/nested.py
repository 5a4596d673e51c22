"""Problem 2: deeply nested records as flat related tables.

Higher-order SQL over the variant type: nested ``transform`` calls attach the path and the position of each value to its
ancestors', ``flatten`` combines the levels, and one ``inline`` for each target table emits its rows. A body's levels are
walked by one ``aggregate`` whose state is (values still to open, objects met), so any depth is covered by the same
expression, without a schema and without rounds over the data.

The JVM's parser has limits (1,000 levels, numbers of 1,000 digits, strings of 20 million characters, 16 to 128 MB a body).
What it rejects is read once more without recursion or limits (``json_text``), and gives the same rows if it is valid JSON.

Scale. Two scans, each of which parses a body once, and no shuffle; a body is opened by itself and holds at most its own
values at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from citelens.operators import json_text

#: Rows of one body turned into Arrow at a time.
_ROWS = 1000

#: A container still to open: its members are cast once, when it is met.
_VALUE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.VariantType())),
        T.StructField("elements", T.ArrayType(T.VariantType())),
    ]
)
_OBJECT = T.StructType(
    [T.StructField("node", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("v", T.VariantType())]
)
_STATE = T.StructType([T.StructField("open", T.ArrayType(_VALUE)), T.StructField("met", T.ArrayType(_OBJECT))])


def _parsed(body: Column) -> Column:
    """The parsed array that has the body between its brackets; NULL for invalid JSON or beyond the parser's limits.

    The parser stops after the first value, so the body is parsed as the only element of an array; a body that closes that
    array itself goes below its own level in ``_nesting``.
    """
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")


def _nesting(body: Column) -> Column:
    """(least, most): how deep the body's arrays and objects are nested, from its brackets outside of strings."""
    outside = F.regexp_replace(F.regexp_replace(body, r"\\.", ""), '"[^"]*+"', "")
    brackets = F.split(F.regexp_replace(outside, r"[^\[\]{}]++", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("least"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.least(s["least"], now).alias("least"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(brackets, zero, step, lambda s: F.struct(s["least"], s["most"]))


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _value(path: Column, parent: Column, v: Column, element: bool, payload: bool) -> Column:
    return F.struct(
        path.alias("path"),
        parent.alias("parent"),
        _fields(v).alias("fields"),
        _elements(v).alias("elements"),
        F.lit(element).alias("element"),
        (v if payload else F.lit(None).cast("variant")).alias("v"),
    )


def _children(value: Column, payload: bool) -> Column:
    """The values within an object or array."""
    prefix = F.when(value["path"] == "", F.lit("")).otherwise(F.concat(value["path"], F.lit(".")))
    fields = F.transform(
        F.map_entries(value["fields"]),
        lambda kv: _value(F.concat(prefix, kv["key"]), value["parent"], kv["value"], False, payload),
    )
    elements = F.transform(
        value["elements"],
        lambda x, i: _value(
            F.concat(value["path"], F.lit("["), i.cast("string"), F.lit("]")), value["parent"], x, True, payload
        ),
    )
    return F.coalesce(fields, elements, F.array())


def _step(state: Column, payload: bool) -> Column:
    """Open the state's containers; an element that is an object is met and becomes the parent of what it holds."""
    below = F.filter(
        F.flatten(F.transform(state["open"], lambda x: _children(x, payload))),
        lambda x: x["fields"].isNotNull() | x["elements"].isNotNull(),
    )
    # An array holds the opened containers, so that they are worked out once for both uses.
    return F.element_at(
        F.transform(
            F.array(below),
            lambda all_: F.struct(
                F.transform(
                    all_,
                    lambda x: F.struct(
                        x["path"].alias("path"),
                        F.when(x["element"] & x["fields"].isNotNull(), x["path"]).otherwise(x["parent"]).alias("parent"),
                        x["fields"].alias("fields"),
                        x["elements"].alias("elements"),
                    ),
                ).alias("open"),
                F.concat(
                    state["met"],
                    F.transform(
                        F.filter(all_, lambda x: x["element"] & x["fields"].isNotNull()),
                        lambda x: F.struct(x["path"].alias("node"), x["parent"].alias("parent"), x["v"].alias("v")),
                    ),
                ).alias("met"),
            ),
        ),
        1,
    )


def _rejected(df: DataFrame, key: str, body: str, payload: bool) -> DataFrame:
    """(key, node, parent[, fields]) of the bodies that the parser rejects but that are valid JSON."""
    kind = df.schema[key].dataType
    types = [to_arrow_type(kind), pa.string(), pa.string()] + [pa.map_(pa.string(), pa.string())] * payload
    schema = pa.schema(list(zip([key, "node", "parent", "fields"], types)))

    def rows(text: str) -> Iterator[tuple]:
        root = json_text.parse(text)
        for node, parent, x in json_text.object_elements(root) if root else ():
            yield (node, parent, [(k, json_text.text_of(y, text)) for k, y in x.inside.items()]) if payload else (node, parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0).slice(i, 1)
                found = rows(batch.column(1)[i].as_py())
                while part := list(islice(found, _ROWS)):
                    keys = own.take(pa.array([0] * len(part)))
                    yield pa.RecordBatch.from_arrays([keys, *map(pa.array, zip(*part), types[1:])], schema=schema)

    ddl = f"`{key}` {kind.simpleString()}, node string, parent string" + ", fields map<string,string>" * payload
    return df.select(key, body).where(F.col(body).isNotNull() & _parsed(F.col(body)).isNull()).mapInArrow(run, ddl)


def object_nodes(df: DataFrame, key: str, body: str, payload: bool = False) -> DataFrame:
    """(key, node, parent[, v, fields]): one row for each JSON object that is an element of an array, at any depth.

    ``node`` is the path from the body's root, ``parent`` that of the nearest enclosing such object, or "". With
    ``payload`` the object itself comes as the variant ``v``, or, where its body is beyond the parser's limits, as the map
    ``fields`` from name to text. A null, empty or invalid body has no rows; null elements keep their positions; a name that
    an object has twice counts once, with its last value; repeated rows of ``df`` each give their rows; further columns are
    ignored.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # valid JSON may repeat a name
    text = F.col(body)
    parsed = df.select(F.col(key), _parsed(text).alias("parsed"), _nesting(text).alias("nesting"))
    one = F.when((F.size("parsed") == 1) & (F.col("nesting.least") >= 0), F.element_at("parsed", 1))
    root = parsed.select(key, one.alias("root"), F.col("nesting.most").alias("levels"))
    whole = F.struct(
        F.lit("").alias("path"),
        F.lit("").alias("parent"),
        _fields(F.col("root")).alias("fields"),
        _elements(F.col("root")).alias("elements"),
    )
    start = F.struct(F.array(whole).alias("open"), F.array().cast(T.ArrayType(_OBJECT)).alias("met")).cast(_STATE)
    met = F.aggregate(
        F.sequence(F.lit(1), F.col("levels") + 1),
        start,
        lambda state, _: F.when(F.size(state["open"]) == 0, state).otherwise(_step(state, payload).cast(_STATE)),
        lambda state: state["met"],
    )
    within = root.select(key, F.inline(met).alias("node", "parent", "v"))
    beyond = _rejected(df, key, body, payload)
    if not payload:
        return within.drop("v").unionByName(beyond)
    return within.withColumn("fields", F.lit(None).cast("map<string,string>")).unionByName(
        beyond.withColumn("v", F.lit(None).cast("variant"))
    )


def flat_table(nodes: DataFrame, key: str, field: str, columns: dict[str, str]) -> DataFrame:
    """One target table: the objects that stand in arrays called ``field``, with typed columns.

    ``nodes`` is ``object_nodes(..., payload=True)``; ``columns`` gives each field's SQL type. A field that is missing, null
    or can't be cast is NULL; numbers written as strings are cast.
    """
    mine = nodes.where(F.regexp_extract("node", r"([^.\[\]]+)(?:\[\d+\])+$", 1) == field)
    typed = [
        F.coalesce(F.try_variant_get("v", f"$['{name}']", kind), F.col("fields")[name].try_cast(kind)).alias(name)
        for name, kind in columns.items()
    ]
    position = F.regexp_extract("node", r"\[(\d+)\]$", 1).cast("int").alias("position")
    return mine.select(key, "node", "parent", position, *typed)
