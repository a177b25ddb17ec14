"""Slots of a host's template (op5)."""

from gridtally.llm import htmltext

SCHEMA = "page_id long, url string, html string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def story(i, n=60):
    return " ".join(WORDS[(i * 7 + k * k) % 10] + str((i + k) % 13) for k in range(n))


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_varying_adverts_and_notices_without_article(spark):
    page = '<body><div class="upper">Buy {0} now</div><h1>Title {0}</h1><div class="text"><p>{1}</p><p>end {0}</p></div><div class="lower">Deal {0} ends</div></body>'
    got = texts(spark, [(i, f"http://h.example/{i}", page.format(i, story(i))) for i in range(8)])
    assert got == {i: f"Title {i} {story(i)} end {i}" for i in range(8)}


def test_slots_learnt_from_articles_serve_pages_without(spark):
    page = '<body><div class="upper">Buy {0} now</div><div class="text">{2}<p>{1}</p>{3}</div><div class="lower">Deal {0} ends</div></body>'
    rows = [(i, f"http://h.example/{i}", page.format(i, story(i), *(("<article>", "</article>") if i else ("", "")))) for i in range(8)]
    assert texts(spark, rows) == {i: story(i) for i in range(8)}


def test_short_teasers_in_articles_are_not_the_text(spark):
    page = '<body><div class="text"><p>{1}</p></div><div class="lower"><article>More {0}</article></div></body>'
    assert texts(spark, [(i, f"http://h.example/{i}", page.format(i, story(i))) for i in range(8)]) == {i: story(i) for i in range(8)}


def test_order_and_nesting(spark):
    rows = [(i, "http://h.example/", "<b id=x>1</b><i id=y>2</i>" + "<dl class=r><dt>k</dt><dd>v%d</dd></dl>" % i * (i % 3 + 1) + ("<u id=u></u><s id=s></s>" if i else "<s id=s></s><u id=u></u>")) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'h' as host", "page_id as uid")
    made = htmltext.templates(df).first()
    sig = lambda name, mark: htmltext.signature(*next(iter(htmltext.tokens(f"<{name} id={mark}>"))))
    assert made["root"].index(sig("b", "x")) < made["root"].index(sig("i", "y"))
    assert len({sig("u", "u"), sig("s", "s")} & set(made["root"])) == 1
    assert [len(c) for c in made["nested"]] == [7]
    a, b = htmltext.Template([1], [[2, 3]]), htmltext.Template([], [[htmltext.signature("open", "q", frozenset()), htmltext.signature("close", "q", frozenset())]])
    assert not list(htmltext.survey("", a)) and [f[0] for f in htmltext.survey("</q><q>", b)].count("bad") >= 1
    assert [f[0] for f in htmltext.survey("<q></q><q></q>", b)] == ["place", "place"]
