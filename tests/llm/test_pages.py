"""Problems 1, 5 and 6 against plain loops over small pages."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citelens.llm import main_text, shared_spans, site_lines
from citelens.llm.lines import page_lines

PAGES = "page_id bigint, url string, html string, line string, site string, h bigint, text string"


def page(i, url, html):
    return (i, url, html, None, "clash", i, "x")


@pytest.mark.parametrize(
    "html, lines",
    [
        (None, []),
        ("", []),
        ("<p>Über <b>u</b>ns</p><br>a&nbsp; b", ["Über uns", "a b"]),
        ("<head><title>x</title></head><body>y<!-- z -->w", ["yw"]),
        ("<script>if(1<2){'<p>'}</script>a<style>b</style>c<noscript>d", ["a", "c"]),
        ("a 1 < 2 &amp; b &#252; &uuml", ["a 1 < 2 & b ü ü"]),
        ("<li>eins<li>zwei <a hre", ["eins", "zwei"]),
        ('<p title="a > b">t</p>', ["t"]),
        ("<header>k</header>", ["k"]),
        ('eins<li><a href="/85', ["eins"]),
        ('<p>eins <a href="/8>zwei</a></p>', ["eins zwei"]),
        ("<i", []),
    ],
)
def test_page_lines(html, lines):
    assert page_lines(html) == lines


def test_broken_pages_take_no_longer():
    import time

    from citelens.llm.main_text import main_lines

    began = time.time()
    for html in ("<a " * 200_000, '<p title="' * 100_000, "<" * 300_000, "<!--" * 100_000, "<script>" * 50_000, "&#" * 200_000,
                 "<div>x" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<article><h1>t</h1>" * 20_000, "<td>a" * 50_000, "<p>a</p>" * 50_000):
        page_lines(html)
        main_lines(html)
    assert time.time() - began < 30


def site_fixture():
    rows, n = [], 0
    for site, count in (("www.A.test", 12), ("b.test", 5), ("c.test", 4)):
        for k in range(count):
            foot = "<p>Impressum</p><p>Kontakt</p>" if k % 4 != 3 else "<p>KONTAKT</p>"
            rows.append(page(n, f"https://{site}/{k}", f"<p>Menü</p><p>Text {n}</p><p>Text {n}</p>{foot}" + ("<p>selten</p>" if k < 3 else "")))
            n += 1
    rows += [page(n, None, "<p>Menü</p>"), page(n + 1, "https://a.test/e", None), page(n + 2, "https://a.test/e", "<p></p>")]
    return rows


def test_repeated_lines_against_counts(spark):
    rows = site_fixture()
    having, pages = Counter(), Counter()
    of = {}
    for i, url, html, *_ in rows:
        lines = {x.lower() for x in page_lines(html)}
        if url and lines:
            site = url.split("/")[2].lower().removeprefix("www.")
            of[i] = (site, lines)
            pages[site] += 1
            having.update((site, x) for x in lines)
    expected = {(i, x) for i, (s, xs) in of.items() for x in xs if having[s, x] >= 5 and having[s, x] >= 0.25 * pages[s]}
    df = spark.createDataFrame(rows, PAGES)
    got = site_lines.repeated_lines(df)
    assert {(r["page_id"], r["line"]) for r in got.collect()} == expected
    assert got.count() == len(expected)
    clean = {r["page_id"]: r for r in site_lines.without_repeated_lines(df).collect()}
    assert len(clean) == len(rows)
    assert clean[0]["text"] == "text 0\nselten" and clean[0]["removed"] == 3
    assert clean[len(rows) - 3]["text"] == "menü" and clean[len(rows) - 2]["text"] == ""
    blocks = {(r["site"], tuple(r["lines"])): r["pages"] for r in site_lines.block_table(df).collect()}
    assert blocks[("a.test", ("impressum", "kontakt"))] == 12


def test_no_pages(spark):
    df = spark.createDataFrame([], PAGES)
    assert site_lines.repeated_lines(df).count() == 0
    assert site_lines.without_repeated_lines(df).count() == 0
    assert main_text.body_lines(df).count() == 0


SENTENCE = "Der Wert einer Wohnung folgt aus der Lage und dem Zustand, wenn man die Miete nicht kennt."
LAYOUTS = {
    "semantic": "<nav><ul><li><a href=1>Start</a></li></ul></nav><main><article>{body}</article></main><aside><h3>Meistgelesen</h3><p>{other}</p></aside><footer><p>© 2024 Haus</p></footer>",
    "sections": "<section><p>Alle annehmen</p></section><section>{body}</section><section><h3>Mehr zum Thema</h3><p>{other}</p></section><section><p>© 2024 Haus</p><p>{other}</p></section>",
    "flat": "Start<br>Suche<br>\n\n\n{body}\n\n\n<h3>Meistgelesen</h3>{other}<br>© 2024 Haus<br>",
    "tables": "<table><tr><td><ul><li><a>Start</a></li></ul></td><td>{body}</td><td><h3>2 Kommentare</h3><p>{other}</p></td></tr></table><table><tr><td><p>© 2024 Haus</p></td></tr></table>",
    "unclosed": "<div class='cookie'><p>Alle annehmen</p><main>{body}</main><footer><p>© 2024 Haus</p>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_body_of_each_layout(name):
    body = (
        f"<h1>Titel in Ort</h1><div>Von der Redaktion Haus</div><p>{SENTENCE}</p><p>Lesen Sie auch: {SENTENCE}</p><h2>Zahlen</h2>"
        "<table><tr><td>Miete</td><td>7 Euro</td></tr></table><ul><li><a>Drucken</a></li></ul>"
    )
    other = SENTENCE.replace("Wohnung", "Garage")
    html = "<head><title>Titel | Haus</title></head><body>" + LAYOUTS[name].format(body=body, other=other) + "</body>"
    templates = frozenset(("von der redaktion", "* auch:", "drucken", "alle annehmen", "© 2024 haus", "start", "suche"))
    assert main_text.main_lines(html, "haus.test", templates) == ["Titel in Ort", SENTENCE, "Zahlen", "Miete", "7 Euro"]


def test_body_edges(spark):
    assert main_text.main_lines(None) == main_text.main_lines("") == main_text.main_lines("<div id=app></div>") == []
    long = "<h1>T</h1>" + f"<p>{SENTENCE}</p>" * 3000
    assert main_text.main_lines(f"<article>{long}</article>") == ["T", SENTENCE]
    rows = [page(1, None, f"<article><h1>T</h1><p>{SENTENCE}</p></article>"), page(1, None, f"<article><h1>T</h1><p>{SENTENCE}</p></article>"), page(None, "x", None)]
    got = main_text.body_lines(spark.createDataFrame(rows, PAGES)).collect()
    assert Counter(tuple(r) for r in got) == Counter({(1, "t"): 2, (1, SENTENCE.lower()): 2})


def test_templates_of_any_length():
    notice = "Wir und unsere Partner nutzen auf der Seite Cookies, damit sie für Sie besser wird, und mit der Zeit auch mehr. " * 4
    flat = f"<h1>Titel</h1>{SENTENCE}<br>{notice}"
    assert main_text.main_lines(flat) == ["Titel", SENTENCE, notice.strip()]
    assert main_text.main_lines(flat, None, frozenset(["wir und unsere"])) == ["Titel", SENTENCE]
    cells = "<h1>T</h1><p>{0}</p><h2>Fazit</h2><table><tr><td>Fazit</td></tr></table><div>Fazit</div>".format(SENTENCE)
    assert main_text.main_lines(f"<article>{cells}</article>", None, frozenset(["fazit"])) == ["T", SENTENCE, "Fazit"]


def test_openings():
    assert main_text.openings("eins") == ["eins"] and main_text.openings("a b c d") == ["a b c"]
    assert main_text.openings("haus a empfiehlt: das") == ["haus a empfiehlt:", "* empfiehlt:"]
    assert main_text.openings("a b c d: e") == ["a b c"] and main_text.openings(": a") == [": a"]


def test_template_openings_against_counts(spark):
    rows = []
    for n in range(40):
        prompt = "<p>Lesen Sie auch: etwas</p>" if n % 5 else f"<p>Haus {n} empfiehlt: das</p>"
        own = "<p>Nur hier</p>" if n % 8 == 0 else ""
        rows.append(page(n, f"https://s{n % 8}.test/{n}", f"<article><h1>Titel {n}</h1><p>{SENTENCE} {n}</p>{own}{prompt}</article>"))
    rows += [page(40, None, None), page(41, "https://s1.test", "<p></p>")]
    df = spark.createDataFrame(rows, PAGES)
    narrow = df.selectExpr("'s' || page_id % 8 as site", "html")
    found = main_text.template_openings(narrow, 0.2, 5, 3)
    assert found == {"lesen sie auch:", "* auch:", "* empfiehlt:", "der wert einer"}
    assert main_text.template_openings(narrow, 0.2, 5, 9) == frozenset()
    texts = df.withColumn("html", F.regexp_replace("html", "Der Wert", F.concat(F.lit("Wert"), "page_id")))
    got = Counter(r["page_id"] for r in main_text.body_lines(texts, 0.2).collect())
    assert got == Counter({n: 2 + (n % 8 == 0) for n in range(40)})


def test_punctuation_hides_no_function_words():
    text = "Warum (und, aber), (so) fragen Eigentümer Notare, Gutachter, Makler, Banken"
    assert main_text.main_lines(f"<p>{text}</p>") == [text]


@pytest.mark.parametrize("site", ["bodenrichtwert.test", "www.bodenrichtwert.co.uk", "bodenrichtwert.com.de"])
def test_site_named_by_its_topic(site):
    lines = ["Bodenrichtwert in Ort", "Der Bodenrichtwert steht in der Karte, und er gilt für ein Jahr.", "Was sagt der Bodenrichtwert?",
             "Bodenrichtwert der Gemeinde", "Bodenrichtwert", "240 Euro"]
    html = "<title>Ratgeber | Bodenrichtwert</title><article><h1>{}</h1><p>{}</p><h2>{}</h2><ul><li>{}</li></ul><table><tr><td>{}</td><td>{}</td></tr></table>{}</article>"
    site_lines = "<p><a href=y>Mein Bodenrichtwert</a></p><p><a href=x>Rechner von Bodenrichtwert</a></p>"
    assert main_text.main_lines(html.format(*lines, site_lines), site) == lines


def test_name_of_a_site():
    assert main_text._names("www.hausblatt.co.uk", "").pattern == main_text._names("hausblatt.test", "").pattern


PASSAGES = "match_id bigint, aio_sentence string, source_sentence string, page_id bigint, html string"


def brute(passages, pages, least):
    found = set()
    for m, a, b, *_ in passages:
        for s in (a, b):
            s = " ".join((s or "x").replace("\t", " ").split(" ")) if s else ""
            s = shared_spans.collapse(s)
            for p, _, html, *_ in pages:
                for line in page_lines(html):
                    if any(s[i : i + least] in line for i in range(len(s) - least + 1)):
                        found.add((m, p))
    return found


def test_shared_spans_against_all_substrings(spark):
    import random

    r = random.Random(4)
    base = ["".join(r.choice("abcde fgh") for _ in range(400)) for _ in range(6)]
    pages = [page(i, "u", f"<p>{base[i % 6][20 * (i % 5):]}</p><p>kurz</p>") for i in range(20)] + [page(99, "u", None)]
    passages = []
    for k in range(60):
        b = base[r.randrange(6)]
        at, n = r.randrange(250), r.choice([98, 99, 100, 101, 150])
        passages.append((k, "x" + b[at : at + n] + "y", "zz  " + b[at + 5 : at + 5 + n] if k % 3 else None, 7, "clash"))
    passages += [(60, None, None, 1, ""), (61, "", "kurz", 1, ""), (62, base[0][:100], None, 1, ""), (62, base[0][:100], None, 1, "")]
    p, q = spark.createDataFrame(passages, PASSAGES), spark.createDataFrame(pages, PAGES)
    got = shared_spans.shared_pairs(p, q)
    assert {tuple(x) for x in got.collect()} == brute(passages, pages, 100)
    sizes = {(x["kind"], x["id"]): x["shared_chars"] for x in shared_spans.shared_sizes(p, q).collect()}
    assert sizes[("passage", 60)] == 0 and sizes[("passage", 62)] == 100 and sizes[("page", 99)] == 0
    spans = shared_spans.shared_spans(p, q).collect()
    assert {(x["match_id"], x["page_id"]) for x in spans} == brute(passages, pages, 100)
    texts, lines = {m: (a, b) for m, a, b, *_ in passages}, {i: page_lines(html) for i, _, html, *_ in pages}
    for x in spans:
        text, line = shared_spans.collapse(texts[x["match_id"]][x["side"]]), lines[x["page_id"]][x["line_no"]]
        assert text[x["text_start"] : x["text_start"] + x["length"]] == line[x["line_start"] : x["line_start"] + x["length"]]
    assert shared_spans.shared_pairs(p.limit(0), q).count() == 0 and shared_spans.shared_pairs(p, q.limit(0)).count() == 0


def test_sentence_runs(spark):
    text = "Eins ist da. Zwei auch! Drei"
    assert shared_spans.sentence_runs(text, 12) == ["Eins ist da.", "Zwei auch! Drei"] and shared_spans.sentence_runs(text, 13) == ["Eins ist da. Zwei auch!", "Zwei auch! Drei"]
    assert shared_spans.sentence_runs(text, 99) == shared_spans.sentence_runs("", 1) == []
    p = spark.createDataFrame([(1, "A" * 60 + ". " + "B" * 60 + ". C", None, 0, ""), (2, "x" * 120, "A" * 60 + ".", 0, "")], PASSAGES)
    q = spark.createDataFrame([page(7, "u", "<p>D. " + "A" * 60 + ". " + "B" * 60 + ".</p>"), page(8, "u", "<p>y" + "x" * 120 + "</p>")], PAGES)
    assert [tuple(x) for x in shared_spans.shared_pairs(p, q, inside=False).collect()] == [(1, 7)]
    assert {tuple(x) for x in shared_spans.shared_pairs(p, q).collect()} == {(1, 7), (2, 8)}


@pytest.mark.parametrize("seed", range(20))
def test_shared_sentences_share_a_run(seed):
    import random

    r = random.Random(seed)
    sentence = lambda: "w" * r.randrange(5, 80) + str(r.random()) + r.choice(".!?")
    shared = [sentence() for _ in range(r.randrange(1, 6))]
    one, two = (" ".join([sentence() for _ in range(r.randrange(3))] + shared + [sentence() for _ in range(r.randrange(3))]) for _ in range(2))
    met = set(shared_spans.sentence_runs(one)) & set(shared_spans.sentence_runs(two))
    assert bool(met) == (len(" ".join(shared)) >= 100)


def test_minimizers_always_meet():
    import random

    r = random.Random(1)
    for _ in range(200):
        span = "".join(r.choice("ab") for _ in range(100))
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(80))) for _ in range(2))
        one, two = (set(shared_spans.minimizers([x])[0].tolist()) for x in (a + span + b, b + span + a))
        assert one & two


def test_shared_runs_are_maximal():
    t = "q" * 30 + "abc" * 40 + "z" + "def" * 40
    line = "abc" * 40 + "y" + "def" * 40
    runs = shared_spans.shared_runs(t, line)
    assert (30, 0, 120) in runs and (151, 121, 120) in runs
    assert all(t[a : a + n] == line[b : b + n] for a, b, n in runs)
