"""Scalar functions on literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from citelens.functions import html, stats, text, url
from citelens.functions.site import site_of


def values(spark, column, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_url_keys_differ(spark):
    a, b = "https://www.V.test/watch?v=A1", "http://v.test/watch?v=B2"
    one = values(spark, url.collector_key, [a, b, "HTTPS://V.test/x/#f", "https://v.test", None, " "])
    assert one == ["https://www.v.test/watch", "http://v.test/watch", "https://v.test/x", "https://v.test/", "", ""]
    two = values(spark, url.repair_key, [a, b, "https://v.test/x/#f", "https://www.v.test/?a=B", None, " http://V.test/p "])
    assert two == ["v.test/watch?v=A1", "v.test/watch?v=B2", "v.test/x", "v.test/?a=B", "", "v.test/p"]
    three = values(spark, url.validation_key, [a, b, "https://v.test/x/?q=1#f", "v.test", None])
    assert three == ["v.test/watch?v=A1", "v.test/watch?v=B2", "v.test/x?q=1", "v.test/", ""]
    assert values(spark, url.passage_key, ["HTTPS://WWW.V.test/X/?a=B#c/"]) == ["v.test/x/?a=b#c"]


def test_domains_and_ids(spark):
    assert values(spark, url.domain_strict, ["https://a.test/x", "https://a.test", None]) == ["a.test", None, None]
    assert values(spark, url.domain_loose, ["https://a.test/x", "https://a.test"]) == ["a.test", "a.test"]
    assert values(spark, url.clean_domain, ["[www.a.test](https://www.a.test)", " WWW.B.test", None]) == ["a.test", "b.test", ""]
    assert values(spark, url.clean_url, ["[a](https://a.test/x)", " https://b.test ", None]) == ["https://a.test/x", "https://b.test", ""]
    assert values(spark, url.offset_seconds, ["https://v/?v=a&t=42s", "https://v/?t=", None]) == [42, None, None]
    links = ["https://www.youtube.com/watch?v=abcdefg&t=1", "https://youtu.be/abcdefg?x", "https://youtube.com/shorts/abcdefg", "https://x.test/?v=abcdefg"]
    assert values(spark, url.video_id_counted, links) == ["abcdefg", "abcdefg", "abcdefg", None]
    assert values(spark, url.video_id_parsed, links) == ["abcdefg", "abcdefg", "abcdefg", None]
    assert values(spark, url.video_id_watch, links) == ["abcdefg", None, None, "abcdefg"]
    wrapped = ["(https://www.A.test/x).", "[a](HTTP://B.test:80/)", "www.c.test/x", None, "", "nothing"]
    assert values(spark, site_of, wrapped) == ["a.test", "b.test", "c.test", None, None, None]


def test_text(spark):
    assert values(spark, text.clean_markdown, ["**Fett** [Wort](http://x) [[1]](http://y) *kursiv*  https://z.test/a Ende"]) == ["Fett Wort kursiv Ende"]
    long = "Eins zwei drei vier fünf sechs. Kurz. Sieben acht neun zehn elf zwölf!"
    assert values(spark, text.sentences, [long]) == [["Eins zwei drei vier fünf sechs.", "Sieben acht neun zehn elf zwölf!"]]
    assert values(spark, text.tokens, ["Über 7,5 % – €30."]) == [["über", "7,5", "%", "€30."]]
    assert values(spark, lambda x: text.ngrams(text.tokens(x), 2), ["a b a b", "a", ""]) == [["a b", "b a"], [], []]
    assert values(spark, text.content_words, ["Die Wohnung und die Lage der Wohnung"]) == [["wohnung", "lage"]]
    assert values(spark, text.word_count, ["", " a  b ", None]) == [0, 2, None]
    assert values(spark, lambda x: F.size(text.passages(x)), ["a b"]) == [1]
    assert values(spark, text.timecode_seconds, ["01:02:03.500", "00:00:01,250"]) == [3723.5, 1.25]
    assert values(spark, text.reading_ease, ["wort " * 10]) == [None]
    t = values(spark, lambda x: F.struct(*[c.alias(k) for k, c in text.traits(x).items()]), ["Das ist ein Wert = 7 Euro"])[0]
    assert (t["n_words"], t["has_number"], t["has_currency"], t["has_formula"], t["has_definition_cue"], t["starts_capital"]) == (7, 1, 1, 1, 1, 1)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(text.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(math.sqrt(0.5)) and got[1] is None or got[1] == 0.0
    assert got[2] == 0.0


PAGE = """<html><head><title>Haus &amp; Hof</title><meta property="article:modified_time" content="2025-01-01T00:00:00Z">
<script type="application/ld+json">{"@graph": [{"@type": "FAQPage", "dateModified": "2026-01-02"}, {"@type": ["A", "B"]}]}</script>
<script type="application/ld+json">{broken</script></head><body><h1>T</h1><p>kurz</p><ul><li>eins</li></ul><table><tr><td>x</td></tr></table>
<h2>Teil</h2><p>eins zwei drei vier fünf sechs sieben acht neun zehn elf</p><details>f</details><time datetime="2999-01-01">x</time><script>no()</script></body></html>"""


def test_parse_page():
    p = dict(zip(html.PARSED.names, html.parse_page(PAGE)))
    assert p["title"] == "Haus & Hof" and p["schema_types"] == ["FAQPage", "A", "B"] and p["has_details"] and p["lists_tables"] == 2
    assert p["dates"] == ["2026-01-02", "2025-01-01T00:00:00Z", "2999-01-01"] and p["first_paragraph_words"] == 11
    assert "no()" not in p["text"] and 0 < p["first_list_pos"] < p["first_table_pos"] < p["first_heading_pos"] < 1
    assert html.parse_page(None) is None and html.parse_page("")[0] == ""


def test_onpage_features(spark):
    rows = [(1, "https://a.test/kaufen", PAGE, True), (2, "http://reddit.com/x", None, False), (3, None, "", True)]
    got = {r["id"]: r for r in html.onpage_features(spark.createDataFrame(rows, "id int, url string, html string, ok boolean"), "2026-01-12", "id").collect()}
    assert (got[1]["has_schema"], got[1]["has_faq"], got[1]["num_lists_tables"], got[1]["content_freshness_days"]) == (1, 1, 2, 10)
    assert got[1]["content_type"] == "transactional" and got[1]["is_https"] == 1
    assert got[2]["has_schema"] is None and got[2]["content_type"] == "informational" and got[2]["is_forum"] == 1
    assert got[3]["word_count"] is None and got[3]["is_video"] == 0


def test_statistics(spark):
    odds, p = stats.fisher_exact(3, 1, 1, 3)
    assert odds == 9 and p == pytest.approx(0.4857142857)
    assert stats.fisher_exact(5, 0, 1, 4)[0] == math.inf
    assert stats.mann_whitney_p(50, 10, 10, 0) == pytest.approx(1.0, abs=0.05)
    df = spark.createDataFrame([(5, 10), (0, 0), (0, 5), (5, 5)], "k int, n int")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = df.select(low.alias("l"), high.alias("h")).collect()
    assert got[0]["l"] < 0.5 < got[0]["h"] and got[1]["l"] is None and got[2]["l"] == 0 and got[3]["h"] == 1


def test_long_urls_take_linear_time(spark):
    import time

    n = 300_000
    rows = ["a" * n, "." * n + "a", "//" * n, "https://a.test" + "/" * n + "x", " " * n + "x" + " " * n + "y", "//" + "a" * n + "."]
    began = time.time()
    assert values(spark, site_of, rows)[3] == "a.test"
    for f in (url.repair_key, url.validation_key, url.passage_key, url.clean_url, url.collector_key):
        values(spark, f, rows)
    assert time.time() - began < 60
