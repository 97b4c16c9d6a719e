"""Pages that nest deeply or lack what is looked for, and the dialects of a page's parts."""

from quotegrid.sources import html, widgets


def test_deep_nesting(spark):
    page = "<div>" * 5000 + "<h1>deep</h1><p>text" + "</div>" * 5000
    got = widgets.widgets(spark.createDataFrame([(1, page), (2, None), (3, "")], "k long, html string"), "k").orderBy("k").collect()
    assert got[0].title == "deep" and [r.title for r in got[1:]] == [None, None]
    assert [r.booking_period for r in got] == [None] * 3 and got[1].people == [] and got[1].cast == []


def test_description_dialects():
    page = widgets.tree("<div class=\"description\">lead<p>one</p><p>two</p></div><h3>More about it</h3><p>a</p><p>b</p><h3>Next</h3><p>c</p>")
    text = lambda **kw: widgets.description(page, widgets.Spec(**kw))
    assert text() == "one\n\ntwo" and text(description_mode="whole") == "lead one two" and text(description_mode="after") == "a\n\nb"
    assert text(description_mode="after", description_words="nowhere") == "one\n\ntwo\n\na\n\nb\n\nc" and text(description="div.none") is None


def test_people_fall_back():
    spec = widgets.Spec(suffix=" -")
    listed = widgets.tree("<li class=\"cast\"><strong>Fool -</strong> Bob</li><div class=\"people\"><dl><dt>x</dt><dd>y</dd></dl></div>")
    terms = widgets.tree("<div class=\"people\"><dl><dt>Writer -</dt><dd>Cy</dd><dt></dt><dd></dd></dl></div><dl><dt>not</dt><dd>here</dd></dl>")
    assert widgets.people(listed, spec) == [{"role": "Fool", "name": "Bob"}]
    assert widgets.people(terms, spec) == [{"role": "Writer", "name": "Cy"}]


def test_state_without_product(spark):
    from pyspark.sql import functions as F

    show, times = html.state_shows(F.col("b"))
    rows = spark.createDataFrame([("{}",), ("no json",), (None,)], "b string").select(show.alias("s"), times.alias("t")).collect()
    assert [(r.s, r.t) for r in rows] == [(None, [])] * 3


def test_advertised_price_without_word_of_seats(spark):
    from quotegrid.operators.verify import band_low_price
    from pyspark.sql import functions as F

    band = "array<struct<price_value: double, seats_available: int>>"
    rows = [([(30.0, None)], 20.0, 0), ([(30.0, 2), (25.0, 0)], 20.0, 4), ([(30.0, 2)], 20.0, 0), ([(30.0, 0)], 20.0, 4), (None, 20.0, None), ([(30.0, 1), (9.0, None)], 20.0, None)]
    got = spark.createDataFrame(rows, f"b {band}, low double, seats int").select(band_low_price(F.col("b"), F.col("low"), F.col("seats")).alias("p")).collect()
    assert [r.p for r in got] == [20.0, 30.0, None, None, 20.0, 30.0]


def test_state_is_parsed_once_by_all_cores(spark, sf_dir):
    from quotegrid.plans import QUERIES

    for name in ("state_shows", "state_showtimes"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and "RepartitionByExpression" in plan


def test_headings_decode_ampersands_alone(spark, tmp_path):
    from quotegrid.plans import QUERIES

    pages = ['<h1>a &amp;&amp b\n <i>&quot;c&quot;</i></h1><p>x</p>', "<h1>&amp;quot; &copy</h1>", "<h1> </h1>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["html_parsed"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [r.h1 for r in rows] == ["a &&amp b &quot;c&quot;", "&quot; &copy", None]
    assert html.parse_page(pages[0])["h1"] == 'a && b "c"'
    assert html.parse_page('<script type="application/ld+json">{"a": "&amp;&"}</script>', True)["ld"] == ['{"a": "&amp;&"}']


def test_plain_pages_read_like_any_other():
    def parsed(page):
        b = widgets._Builder()
        b.feed(page)
        b.close()
        return b.root

    told = lambda root: [(n.tag, n.attrs, [x if isinstance(x, str) else x.at for x in n.children]) for n in root.walk()]
    plain = ['<!DOCTYPE html><p class="a b" id>x &amp; y<br><div data-x="&quot;1">z</p></i></div>', "<script>a < b<c></script><li>", "", '<a href="">&copy</a>']
    other = ["<p>a < b</p>", "<A>x</A>", "<br/>", "<!-- x -->", "<i b='c'>", "<script><!-- x</script>"]
    for page in plain + other:
        assert told(widgets.tree(page)) == told(parsed(page)), page
    assert all(widgets._plain_tree(x) for x in plain) and not any(widgets._plain_tree(x) for x in other)
    root = widgets.tree('<div class="a"><p class="b">1</p><div class="a"><p>2</p></div></div><p class="b">3</p>')
    assert [n.text() for n in root.all("p")] == ["1", "2", "3"] and [n.text() for n in root.within("div.a p")] == ["1", "2"] and root.one("p.b[id]") is None


def test_calendar_links_are_read_once(spark, sf_dir):
    from quotegrid.plans import QUERIES

    plan = QUERIES["calendar_links"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4


def test_pages_leave_no_circles_of_nodes():
    import gc

    page = '<div class="description"><p>a</p><p>b</p></div><h1>x</h1>'
    gc.collect()
    gc.disable()
    try:
        assert widgets.page_widgets(page, only=("description", "title")) == {"title": "x", "description": "a\n\nb"}
        assert not any(isinstance(x, widgets.Node) for x in gc.get_objects())
    finally:
        gc.enable()
