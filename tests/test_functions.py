import datetime
import random

import pytest
from pyspark.sql import functions as F

from quotegrid.functions import prices, similarity, text, times, urls
from quotegrid.operators import offers as O
from quotegrid.sources import html


def one(spark, value, kind, make):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(make(F.col("x")).alias("y")).first()[0]


def many(spark, pairs, kind, make):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], f"i int, x {kind}")
    got = {r.i: r.y for r in df.select("i", make(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(pairs))] == [b for _, b in pairs]


def test_money(spark):
    many(spark, [("£25.00", 25.0), ("£25", 25.0), ("25.00", 25.0), ("£1,234.50", 1234.5), ("  £42.50  ", 42.5), ("£0.01", 0.01), ("", None), (None, None), ("not a price", None)], "string", prices.parse_money)
    many(spark, [("from £12.50 up", 12.5), ("£12,50", None), ("none", None), (None, None)], "string", prices.pound_price)
    many(spark, [("£12,50", 12.5)], "string", lambda c: prices.pound_price(c, True))
    many(spark, [("£20 £5 £4 £20.00 then £601 and £600", [5.0, 20.0, 600.0]), (None, [])], "string", prices.all_pound_prices)


def test_price_expressions(spark):
    many(spark, [(1.0, True), (0.0, False), (-1.0, False), (None, False), (float("nan"), False), (float("inf"), False)], "double", prices.valid_price)
    many(spark, [(20.0, "£20"), (20.5, "£20.50"), (0.0, "—"), (None, "—")], "double", prices.format_price)
    many(spark, [(0.5, 1), (1.4, 1), (2.5, 3)], "double", prices.js_round)
    for n in (1, 2, 5, 6, 10, 11):
        values = [float(i) for i in range(n)]
        want = [sorted(values)[min(n - 1, int(n * p))] for p in prices.PERCENTILES]
        assert one(spark, random.Random(n).sample(values, n), "array<double>", prices.cut_points) == want
    assert one(spark, [], "array<double>", prices.cut_points) == [None] * 4
    many(spark, [(5.0, 1), (10.0, 1), (11.0, 2), (40.0, 4), (41.0, 5), (None, 5)], "double", lambda c: prices.bucket(c, F.array(*[F.lit(x) for x in (10.0, 20.0, 30.0, 40.0)])))
    rows = '<tr class="ticket a" data-cost="20"><td>x</td></tr><tr class="ticket"><td data-cost="30.5">y</td></tr><tr class="ticket"><td>no</td></tr><tr class="ticket" data-cost="9"><td>Sold Out</td></tr><tr class="ticket" data-cost="999"></tr>'
    assert one(spark, rows, "string", prices.ticket_tiers) == [20.0, 30.5]
    many(spark, [(["x/SoldOut", "x/InStock"], True), (["OutOfStock"], False), (["?"], None), ([], None)], "array<string>", prices.stock_state)


def test_times(spark):
    many(spark, [("7:30", "07:30"), ("19:30:00", "19:30"), ("later", "later"), ("", None), (None, None)], "string", times.canonical_time)
    many(spark, [("7:30", 450), ("23:59", 1439), ("24:00", None), ("x", None), (None, None)], "string", times.minutes)
    many(spark, [("18:10", True), ("18:20", False), ("10:00", True), (None, False), ("tbc", False)], "string", lambda c: times.imminent_or_past(c, 18 * 60))
    many(spark, [("7.30pm", "19:30"), ("7:30 PM", "19:30"), ("12-00am", "00:00"), ("12pm", "12:00"), ("13pm", None), ("x", None)], "string", times.twelve_hour)
    many(spark, [("2026-05-21T19:00:00+01:00", ("2026-05-21", "19:00")), ("2026-05-21", ("2026-05-21", None)), ("x", (None, None))], "string", lambda c: F.struct(*times.iso_split(c)))
    near = F.lit(datetime.date(2026, 1, 5))
    many(spark, [((28, 12), datetime.date(2025, 12, 28)), ((3, 2), datetime.date(2026, 2, 3)), ((29, 2), None)], "struct<d: int, m: int>", lambda c: times.nearest_year_date(c["d"], c["m"], near))
    assert one(spark, (29, 2), "struct<d: int, m: int>", lambda c: times.nearest_year_date(c["d"], c["m"], F.lit(datetime.date(2024, 6, 1)))) == datetime.date(2024, 2, 29)
    now = F.lit("2026-01-10 12:00:00").cast("timestamp")
    ago = lambda c: times.relative_time(c.cast("timestamp"), now)
    many(spark, [("2026-01-10 11:55:00", "5m ago"), ("2026-01-10 09:00:00", "3h ago"), ("2026-01-08 12:00:00", "2d ago"), ("2025-12-13 12:00:00", "4w ago"), (None, "—")], "string", ago)
    assert one(spark, ["19:30", "14:30"], "array<string>", times.compact_times) == "14:30, 19:30" and one(spark, ["a", "b", "c"], "array<string>", times.compact_times) == "3 PERFS"
    assert one(spark, datetime.date(2024, 1, 29), "date", lambda c: times.week_label(c, F.date_add(c, 6))) == "29 JAN–4 FEB"


def test_weekends():
    day = datetime.date
    assert O.weekend_dates(day(2024, 1, 10)) == [day(2024, 1, 12), day(2024, 1, 13), day(2024, 1, 14)]
    assert O.weekend_dates(day(2024, 1, 12)) == [day(2024, 1, 13), day(2024, 1, 14)]
    assert O.weekend_dates(day(2024, 1, 13)) == [day(2024, 1, 14)]
    assert O.weekend_dates(day(2024, 1, 14)) == [day(2024, 1, 19), day(2024, 1, 20), day(2024, 1, 21)]


def test_text_keys():
    assert text.title_key("Mamma Mia!") == "mamma mia"
    assert text.title_key("Disney's The Lion King") == "lion king"
    assert text.title_key("La bohème") == "la boheme"
    assert text.title_key("Jesus Christ Superstar - The Palladium", "london palladium") == "jesus christ superstar the palladium"
    assert text.title_key("A Midsummer Night's Dream - Globe Theatre", text.venue_key("Shakespeare's Globe")[0]) == "midsummer nights dream"
    assert text.title_key("Six: The Musical (Evening) ") == "six"
    assert text.title_key("Cinderella: The Pantomime [2024]") == "cinderella" and text.title_key(None) == "" and text.title_key("!!!") == ""
    assert text.venue_key("The Kit Kat Club") == ("kit kat club at the playhouse", "Kit Kat Club at the Playhouse Theatre")
    assert text.venue_key("Drury Lane, Theatre Royal")[1] == "Theatre Royal Drury Lane"
    assert text.venue_key("  Café Théâtre, London ") == ("cafe theatre", "Café Théâtre, London") and text.venue_key("") == (None, None) and text.venue_key("?!") == (None, None)
    assert text.mended("Nightâ\x80\x99s Dream’s") == "Night’s Dream’s" and text.mended("Ch\xc2telet \xc2 x") == "Ch\xc2telet  x"


def test_text_columns(spark):
    df = spark.createDataFrame([("La bohème", None), (None, "old vic"), ("La bohème", None)], "title string, venue string")
    got = df.withColumn("key", text.normalize_title(F.col("title"), F.col("venue"))).collect()
    assert sorted((r.title or "", r.key) for r in got) == [("", ""), ("La bohème", "la boheme"), ("La bohème", "la boheme")]
    assert one(spark, "Old Vic", "string", text.normalize_venue).asDict() == {"venue_norm": "old vic", "venue_canonical": "The Old Vic"}
    many(spark, [("&amp;amp; x &#163;5 ", "& x £5"), ("  ", None), (None, None)], "string", text.unescape_html)
    many(spark, [("The King's Head’s Bar & Grill!", "the-kings-heads-bar-grill")], "string", text.slug)
    many(spark, [("MAMMA MIA!", True), ("Mamma Mia!", False), ("123", False)], "string", text.shouting)
    many(spark, [("# Head\n\nOne **bold**\nline.\n\n\n[link](http://x) two", ["Head", "One bold line.", "link two"])], "string", text.paragraphs)
    many(spark, [("closing 1 May\nOpens soon\nClosing 2 May", "Closing 2 May"), ("x", None)], "string", lambda c: text.notice(c, "closing"))
    many(spark, [("Hall, Street 1\nLondon", "Hall"), (", x", None)], "string", text.venue_first_part)
    many(spark, [("Title Tickets", "Title"), ("Title", "Title")], "string", lambda c: text.without_suffix(c, " Tickets"))
    import hashlib

    assert one(spark, 1.5, "double", lambda c: text.input_hash(F.lit("a"), F.lit(None).cast("string"), text.number_text(c))) == hashlib.sha1(b"a|none|1.500000").hexdigest()[:16]
    assert one(spark, "ttd", "string", text.seller_label) == "Theatre Tickets Direct" and one(spark, "x", "string", text.seller_label) == "x"


def test_urls(spark):
    many(spark, [("https://x/shows/seats/1?a#b", "https://x/shows/seats/1"), ("https://x/other?a", "https://x/other?a"), (None, None), ("", "")], "string", urls.clean)
    many(spark, [("https://x.y/a/b-c/?q", "b-c"), ("https://x.y", None)], "string", urls.slug_of)
    many(spark, [("14:00", "2-00pm"), ("00:30", "12-30am"), ("12:00", "12-00pm"), ("25:00", None), ("x", None), (None, None)], "string", urls.time_segment)
    assert one(spark, datetime.date(2026, 5, 21), "date", urls.date_segment) == "21-may-2026"
    assert one(spark, "19:00", "string", lambda t: urls.ticket_page(F.lit("https://s/show"), F.lit(datetime.date(2026, 5, 21)), t)) == "https://s/show/tickets/21-may-2026/7-00pm/"
    many(spark, [("https://x/a’b?q=é&r=1%20", "https://x/a%E2%80%99b?q=%C3%A9&r=1%20"), (None, None), ("", "")], "string", urls.ascii_safe)
    assert one(spark, 7, "long", lambda i: urls.booking_query("https://b", F.lit(3), i, F.lit("2026-05-21"), F.lit("19:00"))) == "https://b?product_id=3&qt=2&showtime_id=7&date=2026-05-21&slot=19%3A00"
    assert one(spark, None, "long", lambda i: urls.booking_query("https://b", F.lit(3), i, F.lit(""), F.lit(""))) is None


def test_similarity():
    assert similarity.token_set_ratio("lion king", "the lion king") == 100.0
    assert similarity.score("abc", "abd") == 0 and similarity.score("hamilton", "hamilton tour") == 100 and similarity.score("", "x") == 0
    assert similarity.indel_ratio("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)
    rnd = random.Random(1)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rnd.choice("ab ") for _ in range(rnd.randrange(9))) for _ in "12")
        assert similarity.common_length(a, b) == lcs(a, b)
    # against the definition on whole strings
    def plain(a, b):
        x, y = set(a.split()), set(b.split())
        s = " ".join(sorted(x & y))
        l, r = (" ".join(filter(None, (s, " ".join(sorted(z))))) for z in (x - y, y - x))
        if s and (not x - y or not y - x):
            return 100.0
        ratio = lambda p, q: 200 * lcs(p, q) / (len(p) + len(q)) if p or q else 100
        return max([ratio(s, l), ratio(s, r)] if s else [0]) , 200 * (len(s) + bool(s) + lcs(" ".join(sorted(x - y)), " ".join(sorted(y - x)))) / (len(l) + len(r))

    for _ in range(200):
        a, b = (" ".join(rnd.choice(["lion", "king", "the", "queen", "tour"]) for _ in range(rnd.randrange(1, 5))) for _ in "12")
        want = plain(a, b)
        assert similarity.token_set_ratio(a, b) == pytest.approx(max(want) if isinstance(want, tuple) else want)


def test_gate_as_expression(spark):
    rnd = random.Random(3)
    words = ["lion", "king", "the", "hamilton", "of", "and", "wicked"]
    pairs = [(" ".join(rnd.sample(words, rnd.randrange(1, 4))), " ".join(rnd.sample(words, rnd.randrange(1, 4)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r.g == similarity.gate(r.a, r.b) for r in df.select("a", "b", similarity.gate_expr(F.col("a"), F.col("b")).alias("g")).collect())


def test_html(spark):
    plan = '{"ResultCode":"0","data":{"Performances":[{"SeatIdOnMap":"1"},{"SeatIdOnMap":"2"}],"PriceBands":[{"Price":"£40.00","FaceValue":"£32.50"},{"Price":"£25","FaceValue":"£20"},{"Price":"£25.00","FaceValue":"£20.00"},{"Price":"£999","FaceValue":"£0.01"}]}}'
    assert one(spark, plan, "string", html.seat_plan).asDict() == {"result_code": "0", "tiers": [25.0, 40.0], "face_tiers": [20.0, 32.5], "seats": 2}
    many(spark, [("", None), ("<html>", None), ('{"ResultCode":', None), ("[1]", None)], "string", html.seat_plan)
    assert one(spark, '{"ResultCode":"1","data":null}', "string", html.seat_plan).asDict() == {"result_code": "1", "tiers": [], "face_tiers": [], "seats": 0}
    page = """<html lang="en"><head><script type="application/ld+json">{"@type":"TheaterEvent","name":"A","startDate":"2026-05-21T19:00:00+01:00","offers":{"price":0,"lowPrice":20,"priceCurrency":"GBP","availability":"InStock","url":"u"}}</script>
<script type="application/ld+json">[{"@type":"Product","name":"P\tq"},{"@type":"TheaterEvent","startDate":"2026-05-22"}]</script><script type="application/ld+json">{broken</script></head>
<body><h1> A &amp; B </h1><a href="/x">one</a><a href="/y">two</a><p>Text <b>bold</b></p><img data-src="i.png" src="s.png"><table><tr><td>Mon</td><td>-</td></tr></table><script>var t="</p>";</script></body></html>"""
    perfs = one(spark, page, "string", lambda h: html.ld_performances(html.ld_items(h)))
    assert [tuple(p) for p in perfs] == [("2026-05-21", "19:00", 20.0, "GBP", "InStock", "u")]
    assert one(spark, page, "string", lambda h: F.size(html.ld_of_type(html.ld_items(h), "Product"))) == 1
    got = html.parse_page(page)
    assert got["h1"] == "A & B" and got["links"] == [{"href": "/x", "text": "one"}, {"href": "/y", "text": "two"}] and got["paragraphs"] == ["Text bold"] and got["images"] == ["i.png"] and got["rows"] == [["Mon", None]] and len(got["ld"]) == 3
    assert html.parse_page(None)["h1"] is None
    crm = "fireCrmEvent('Viewed Performance', {'min_price': 12, 'max_price': 40.5, 'is_discounted': true})"
    assert one(spark, crm, "string", html.tracking_event).asDict() == {"min_price": 12.0, "max_price": 40.5, "price": None, "is_discounted": True, "is_no_booking_fee": None}
    assert one(spark, "none", "string", html.tracking_event) is None
    cal = '<a href="/shows/seats/7/a/11" data-date="2026-05-21" data-time="19:00">£20</a><a href="/shows/seats/7/a/0" data-date="2026-05-21" data-time="19:00">£20</a><a href="/shows/seats/8/a/12" data-date="2026-05-21" data-time="19:00">£20</a>'
    assert [tuple(x) for x in one(spark, cal, "string", lambda h: html.calendar_anchors(h, "7"))] == [(0, "2026-05-21", "19:00", "11", 20.0)]
    many(spark, [("background:url('a(b).png')", "a(b).png"), ("background: url( x.png )", "x.png"), ("none", None)], "string", html.background_image)
    many(spark, [("Ages 14+ only", "14+"), ("All Ages", "all ages"), ("x", None)], "string", html.age_label)
    nested = '{"years":{"open":true,"2026":{"months":{"5":{"days":{"7":{"perfs":[{"perf_id":"9","time":"19:00","price":20.0,"seats":3}]},"any":false}},"has_more":true}}}}'
    rows = html.nested_calendar(spark.createDataFrame([(1, nested), (2, None), (3, "x")], "k int, body string"), "k", "body").collect()
    assert [tuple(r) for r in rows] == [(1, "2026-05-07", "9", "19:00", 20.0, 3)]


LISTING = """<html><body><nav class="breadcrumb"><a href="/">Home</a><a href="/m">Musicals</a></nav><h1>Wicked <small>now</small></h1>
<div class="info"><dl><dt>Running time</dt><dd>2h 30m</dd><dt>Closing date</dt><dd>1 May</dd></dl></div>
<ul><li class="cast"><strong>Elphaba:</strong> – A. Name</li><li class="cast">Only Name</li></ul>
<div class="description"><p>First.</p><p>Read more</p><p>Second &amp; last.</p></div>
<div class="hero" style="background-image: url('a(1).jpg')"></div><div class="gallery"><img data-src="l.png" src="s.png"><img src="t.png"><img src="t.png"></div>
<section id="show-time"><table><tr><th>Mon</th><td>-</td><td>7.30pm</td></tr><tr><th>Tue</th></tr></table></section>
<section id="last-minute"><table><tr><td><a class="last-minute__performance-link deal" href="/p1" data-id="11">7pm</a></td><td></td></tr></table></section>
<article class="deal" data-discount="0" data-min-price="20"><div><p>Today 7:30pm from £25.50</p><a href="/book/1">Book</a></div></article><article class="deal" data-discount="0"></article>
<div data-cal="{&quot;performances&quot;:[{&quot;date&quot;:&quot;2026-05-01&quot;,&quot;time&quot;:&quot;19:00&quot;,&quot;min&quot;:20,&quot;avail&quot;:1}]}"></div>
<a class="book-now" href="/b">From £30,50 <span class="badge">Save £5</span></a><div class="offer"><h3>Half price</h3> until Friday</div>
<article class="card genre-musical" data-id="7"><h2>One</h2><a href="/one">x</a></article><article class="card" data-id="7"><h2>Again</h2></article><article class="card" data-id="8"><a href="/two">Two</a></article>
<a class="tag" href="/tags/new-shows/">New</a><div class="access"><div>Wheelchair spaces</div><div>Nothing</div></div>
<div class="next-availability"><h4>Fri 1</h4><a href="/n1">19:30</a><a href="/n2">14:30</a></div><a class="month" href="/m5">May 2026</a></body></html>"""


def test_widgets(spark):
    from quotegrid.sources import widgets as W

    got = {r.k: r for r in W.widgets(spark.createDataFrame([(1, LISTING), (2, None), (3, "<p>odd </b> <i>page")], "k int, html string"), "k").collect()}
    r = got[1]
    assert (r.title, r.closing_label, r.closing, r.category) == ("Wicked", "Closing date", "1 May", "Musicals") and r.labels["Running time"] == "2h 30m"
    assert [(p.role, p.name) for p in r.people] == [("Elphaba:", "A. Name"), (None, "Only Name")]
    assert r.description == "First.\n\nSecond & last." and r.hero == "a(1).jpg" and r.gallery == ["l.png", "t.png"]
    assert [tuple(x) for x in r.weekly] == [("Mon", None, "7.30pm")] and [tuple(x) for x in r.last_minute] == [("0", "7pm", "/p1", "11", "true")]
    assert [tuple(x) for x in r.deals] == [(None, 20.0, None, "/book/1", "7:30pm", 25.5)]
    assert [tuple(x) for x in r.calendar] == [("2026-05-01", "19:00", 20.0, None, True, None)]
    assert (r.price, r.on_offer, r.offer_title, r.offer) == (30.5, True, "Half price", "until Friday")
    assert [(c.pos, c.key, c.title, c.url, c.genres) for c in r.cards] == [(0, "7", "One", "/one", ["musical"]), (2, "8", "Two", "/two", [])]
    assert [tuple(t) for t in r.tags] == [("New", "/tags/new-shows/", "new-shows")] and r.access == ["Wheelchair spaces"]
    assert [tuple(x) for x in r.next_rows] == [("Fri 1", "19:30", "/n1"), ("Fri 1", "14:30", "/n2")] and [tuple(x) for x in r.months] == [("May 2026", "May", 2026, "/m5")]
    assert got[2].title is None and got[3].cards == []
    assert W.weekly_from_lines(["Mon", "2pm, 7pm", "Tue", "-"]) == [{"day": "Mon", "times": ["2pm", "7pm"]}, {"day": "Tue", "times": []}]
    assert one(spark, {"StreetAddress": "x", "postalcode": ""}, "map<string, string>", lambda m: W.any_case(m, "streetaddress")) == "x"
    assert one(spark, {"postalcode": ""}, "map<string, string>", lambda m: W.any_case(m, "postalCode")) is None
    body = one(spark, "https://x/venues/44/name", "string", lambda u: W.seat_request(F.lit(9), F.lit(3), u, F.lit("2026-05-21"), F.lit("19:00")))
    assert (body.PDate, body.Time, body.VenueId, body.performanceId) == ("21/05/2026", "19-00", "44", "9")
    for d, t, u in ((None, "19:00", "/venues/1/"), ("2026-05-21", None, "/venues/1/"), ("2026-05-21", "19:00", "none"), ("x", "19:00", "/venues/1/"), ("2026-05-21", "1900", "/venues/1/")):
        assert one(spark, u, "string", lambda c, d=d, t=t: W.seat_request(F.lit(9), F.lit(3), c, F.lit(d).cast("string"), F.lit(t).cast("string"))) is None
    items = [(2, "B", "/category/b"), (None, "C", "/category/c"), (1, "A", "/x")]
    assert one(spark, items, "array<struct<position: int, name: string, url: string>>", W.crumb_category) == "B"
    kind = "struct<`@type`: string, name: string>"
    many(spark, [('{"@graph":[{"@type":"Product","name":"p"}]}', ["p"]), ('{"@type":"X","name":"q"}', ["q"])], "string", lambda s: F.transform(W.graph_items(s, kind), lambda x: x["name"]))
    assert one(spark, "", "string", lambda s: W.canonical_url(s, F.lit("own"))) == "own" and one(spark, " ", "string", lambda s: W.first_filled(s, F.lit("b"))) == "b"
