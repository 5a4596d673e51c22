"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from citelens.functions import serp, url
from citelens.schemas import CANDIDATES, require_columns
from citelens.sources import readers, sinks
from citelens.streaming import incremental

RESPONSE = {
    "tasks": [{"result": [{"keyword": "k", "item_types": ["organic"], "items": [
        {"type": "ai_overview", "markdown": "**M**", "asynchronous_ai_overview": True,
         "references": [{"url": "https://a.test/1", "domain": "a.test"}, {"url": "[x](https://b.test/2)", "domain": "[www.b.test](x)"}],
         "items": [{"type": "e", "text": "T", "title": "U", "references": [{"url": "https://c.test/3", "text": "s"}, None]}, {"title": None, "references": None}]},
        None,
        {"type": "organic", "rank_group": 1, "url": "http://www.a.test/1/", "title": "t"},
        {"type": "organic", "rank_group": "2", "url": "https://d.test/"},
        {"type": "people_also_ask", "items": [{"title": "Was?"}, {"title": " "}, {"title": None}]},
        {"type": "related_searches", "items": ["x", "y"]},
    ]}]}]
}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "q0001.json").write_text(json.dumps(RESPONSE))
    (tmp_path / "q0002.json").write_text("{broken")
    (tmp_path / "q0003.json").write_text('{"tasks": []}')
    (tmp_path / "note.txt").write_text("x")
    return tmp_path


def test_responses(spark, folder):
    assert {r["query_id"] for r in readers.read_responses(spark, str(folder)).collect()} == {"q0001", "q0002", "q0003"}
    good = readers.read_results(spark, str(folder))
    assert [r["query_id"] for r in good.select("query_id").collect()] == ["q0001"]
    assert readers.rejected_responses(spark, str(folder)).count() == 2
    facts = serp.query_facts(good).first()
    assert (facts["num_organic_results"], facts["ai_overview_num_references"], facts["ai_overview_is_async"], facts["has_people_also_ask"]) == (2, 3, 1, 1)
    rows = {r["url"]: (r["organic_rank"], r["cited"]) for r in serp.candidates(good, "query_id", url.repair_key).collect()}
    assert rows == {"http://www.a.test/1/": (1, 1), "https://d.test/": (2, 0), "https://b.test/2": (101, 1), "https://c.test/3": (101, 1)}
    assert [r["cited_domain"] for r in serp.citations(good, "query_id").collect()] == ["a.test", "b.test", ""]
    assert good.select(serp.overview_text(F.col("result"))).first()[0] == "**M**\nT\nU"
    assert good.select(serp.questions(F.col("result"))).first()[0] == ["Was?"]
    readers.register_cached_responses(spark)
    assert spark.read.format("cached_responses").load(str(folder)).count() == 3


def test_suggestions(spark):
    body = json.dumps({"tasks": [{"result": [{"items": [
        {"keyword": "Haus", "keyword_info": {"search_volume": 5}}, {"keyword": "haus", "keyword_info": {"search_volume": 9}}, {"keyword": ""}, {"keyword": "x", "keyword_info": None}]}]}]})
    found = serp.keyword_suggestions(spark.createDataFrame([(body,), ("{}",)], "body string"), "body")
    assert found.count() == 3
    seeds = spark.createDataFrame([("HAUS",), ("neu",)], "keyword string")
    got = [tuple(r) for r in serp.expand_seeds(found, seeds).collect()]
    assert got[0] == ("haus", 9) and len(got) == 3


def test_pages_queries_vtt(spark, tmp_path):
    (tmp_path / "q0001__03.html").write_bytes(b"<p>\xff</p>")
    (tmp_path / "other.html").write_text("x")
    got = readers.read_pages(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("q0001", 3, "<p>�</p>")]
    (tmp_path / "q.txt").write_text("# no\n\n  eins \nzwei\n")
    assert [r[0] for r in readers.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["eins", "zwei"]
    vtt = "WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.000\n<c>Hallo</c> Welt\n\n00:00:02,500 --> 00:00:03.000\nHallo Welt\n\n00:01:00.000 --> 00:01:01.000\nEnde"
    (tmp_path / "abc.de.vtt").write_text(vtt)
    row = readers.read_vtt(spark, str(tmp_path)).first()
    assert row["video_id"] == "abc" and [tuple(s) for s in row["snippets"]] == [(1.0, "Hallo Welt"), (60.0, "Ende")]
    texts = [(1, None), (2, ""), (3, "WEBVTT\r\n\r\nNOTE x --> y\r\n\r\n00:05.250 --> 00:07.000 align:start\r\na\r\n<i>b</i>\r\n\r\n01:00:00.000 --> 01:00:01.000\r\n")]
    made = {r["i"]: r["c"] for r in spark.createDataFrame(texts, "i int, t string").select("i", readers.vtt_captions(F.col("t")).alias("c")).collect()}
    assert made[1] is None and made[2] == [] and [tuple(x) for x in made[3]] == [(5.3, "a b")]


def test_candidates_contract(spark, tmp_path):
    made = readers.synthetic_candidates(spark, 30, 1)
    names = [x.split()[0] for x in CANDIDATES.split(", ")]
    assert made.columns == names
    each = made.groupBy("query_id").agg(F.sum("cited").alias("k"), F.count("*").alias("n")).collect()
    assert len(each) == 30 and all(1 <= r["k"] <= 8 and 8 <= r["n"] <= 29 for r in each)
    rate = readers.synthetic_candidates(spark, 300, 0).agg(F.avg("cited"), F.corr("cited", "query_url_similarity"), F.corr("cited", "organic_rank")).first()
    assert 0.05 < rate[0] < 0.35 and rate[1] > 0.1 > -0.1 > rate[2]
    sinks.write_csv(made.withColumn("extra", F.lit("x")), str(tmp_path / "c.csv"))
    back = readers.read_candidates(spark, str(tmp_path / "c.csv"))
    assert back.count() == made.count() and dict(back.dtypes)["organic_rank"] == "int" and "extra" in back.columns
    with pytest.raises(ValueError, match="cited"):
        require_columns(made.drop("cited"), names)
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, str(tmp_path / "none"))
    assert sinks.replace_view(made, "made") == made.count()
    assert "n" in json.loads(sinks.metrics_json(a=made.agg(F.count("*").alias("n"))))["a"][0]


def test_stream_appends_once(spark, folder, tmp_path):
    table, mark = str(tmp_path / "t"), str(tmp_path / "m")
    incremental.collect_responses(spark, str(folder), table, mark).awaitTermination()
    (folder / "q0009.json").write_text("{}")
    incremental.collect_responses(spark, str(folder), table, mark).awaitTermination()
    assert sorted(r["query_id"] for r in spark.read.parquet(table).collect()) == ["q0001", "q0002", "q0003", "q0009"]


def test_finalise_and_windows(spark):
    raw = spark.createDataFrame([("a", 1, None), ("a", 0, 3.0), (None, 1, 5.0)], "domain string, cited int, word_count double")
    out = {(r["domain"], r["cited"]): r for r in incremental.finalise(raw, ["word_count"], [], "domain", "cited").collect()}
    assert out[("a", 1)]["domain_citation_rate"] == 0.5 and out[("a", 1)]["word_count"] == 4.0 and out[(None, 1)]["domain_citation_rate"] == 1.0
    events = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,i*20) as ts, 'a' as event_type, 1.0 as value, 1 as user_id from (select explode(sequence(0,5)) i)")
    assert incremental.event_windows(events).count() == 2
    assert incremental.sessions(events).first()["n"] == 6


def test_late_rows_and_bounded_state(spark, tmp_path):
    """Rows behind the watermark are left out, and closed windows leave the state."""
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def feed(*minutes: int) -> None:
        rows = spark.createDataFrame([(m, "a", 1.0) for m in minutes], "m int, event_type string, value double")
        rows.selectExpr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m) as ts", "event_type", "value").write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(source)
        q = (
            incremental.event_windows(stream, late="30 minutes").writeStream.outputMode("update")
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{target}/batch={batch}"))
            .option("checkpointLocation", mark).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    feed(5, 10)
    run()
    feed(400)
    run()
    feed(15, 410)  # the first is more than half an hour behind
    assert run() == 1
    got = {r["start"].hour: r["n"] for r in incremental.latest(spark.read.parquet(target), ["start", "event_type"], "batch").collect()}
    assert got == {0: 2, 6: 2}
