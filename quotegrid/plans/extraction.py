"""Queries over extraction: pages are made from table rows, so that what is to be
found in them is known from the columns; the SQL states that, without any page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices, text, times, urls
from ..operators import merge as M
from ..sources import adapters as A
from ..sources import html as H
from ..sources import widgets as W
from .base import query

c = F.col
#: Tasks for each core, so that one slow core holds up little.
DEALT = 2

#: What stands for the names in a template, in words of both engines.
TOKENS = {
    "k": "p_partkey",
    "name": "p_name",
    "brand": "p_brand",
    "size": "p_size",
    "until": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('Day ', p_partkey) END",
    "matinee": "CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '14:30' END",
    "day": "concat('2024-01-', 10 + p_partkey % 20)",
    "cents": "10 + p_partkey % 90",
    "none": "CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE 'cast' END",
    "discount": "p_partkey % 3",
    "button": "CASE WHEN p_partkey % 2 = 0 THEN 'book-action' ELSE 'other' END",
    "panel": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(p_partkey, ' Panel Street') END",
}


def _parts(template: str) -> list[str]:
    return [x for x in re.split(r"(\{[a-z]+\})", template) if x]


def made(template: str) -> Column:
    """A text with the names in braces replaced by a row's values."""
    return F.concat(*[F.expr(TOKENS[x[1:-1]]) if x.startswith("{") and x[1:-1] in TOKENS else F.lit(x) for x in _parts(template)])


def said(template: str) -> str:
    """The same text in SQL."""
    return "concat(" + ", ".join(TOKENS[x[1:-1]] if x.startswith("{") and x[1:-1] in TOKENS else "'" + x.replace("'", "''") + "'" for x in _parts(template)) + ")"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt over tasks: a file of a few MB is read by one task, and what
    is made of each row costs far more than moving the few columns that it is made of."""
    return A.read(spark, sf_dir, "part").repartition(DEALT * spark.sparkContext.defaultParallelism, "p_partkey")


PAGE = """<!DOCTYPE html><html lang="en"><head><title>x</title><script>var t = "<h1>no</h1>";</script></head><body>
<nav class="breadcrumb"><a href="/">Home</a><a href="/shows">Shows</a><a href="/c">{brand}</a></nav>
<figure class="show-hero"><figcaption><img class="mobile-img" src="m.gif"><img src="t.gif" data-src="thumb{k}.jpg"></figcaption></figure>
<ul class="show-meta"><li class="duration"><svg></svg>  {size}
 minutes </li><a href="/venue/{k}/"><li class="location"> {brand}  Hall</li></a></ul><span class="badge-category">Musical</span>
<h1> <em> </em>{name}<small>now {k}</small></h1>
<div class="info"><dl><dt>Running time</dt><dd>{size} min</dd><dt>Booking until</dt><dd>{until}</dd><dt>Closing date</dt><dd>End {k}</dd></dl></div>
<ul><li class="{none}"><strong>Lead as</strong>: Ann {k}</li><li class="{none}"><strong>Fool as</strong> – Bob</li></ul>
<div class="people"><dl><dt>Writer as</dt><dd>Cy {k}</dd></dl></div>
<h2>The London Cast</h2><p>Main:</p><ul><li><strong>King:</strong> - Dee {k}</li><li>no role</li><li><strong>Queen</strong> — Eve</li></ul><h2>Other</h2><ul><li><strong>No</strong> - one</li></ul>
<div class="description"><p>First of {k}.</p><p>Read more</p><p>  Second
 of {name}.</p></div>
<div class="hero" style="background: red url('http://img.example/({k}).jpg') no-repeat"></div>
<div class="gallery"><img src="a.gif" data-src="b{k}.jpg"><img src="b{k}.jpg"><img src="c.jpg"></div>
<section id="show-time"><table><tr><th>Mon</th><td>{matinee}</td><td>19:30</td></tr><tr><th>Tue</th><td>14:30</td><td>-</td></tr><tr><td>stray</td></tr></table></section>
<section id="last-minute"><table><tr><td><a class="last-minute__performance-link has-deal" data-id="{k}" href="/p/{k}">19:30</a></td><td></td><td><a class="last-minute__performance-link" href="/q/{k}">14:30</a></td></tr></table></section>
<article class="deal" data-discount="{discount}" data-min-price="{k}" data-max-price=""><p>Today at 7:30pm from £{cents}.50 <a href="/book/{k}">Book</a> <a href="/info">more</a></p></article>
<div data-cal="{{&quot;performances&quot;:[{{&quot;date&quot;:&quot;{day}&quot;,&quot;time&quot;:&quot;19:30&quot;,&quot;min&quot;:{cents},&quot;max&quot;:{k},&quot;avail&quot;:1,&quot;bookUrl&quot;:&quot;/b?a=1&amp;amp;k={k}&quot;}}]}}"></div>
<a class="book-now" href="#">From £{cents}.25 <span class="badge">Save £5</span></a>
<div class="offer"><h3>Offer {k}</h3> Two for {cents}</div>
<a class="tag" href="/tags/slug-{k}/">Tag {k}</a>
<div class="access"><div>Wheelchair spaces: {size}</div><div>Nothing</div><p>toilet</p></div>
<div class="next-availability"><h4>Mon {k}</h4><a href="/n/{k}">19:30</a></div>
<a class="month" href="/m/{k}">January 2024</a>
<article class="card genre-play genre-drama" data-id="{k}"><h2>{name}</h2><a href="/s/{k}">go</a></article><article class="card" data-id="{k}"><h2>again</h2></article><article class="card" data-id="z"><a href="/z">Zed</a></article>
<div id="booking-period"><p>1 Jan - {day}</p></div><div id="venue"><article><p class="address">{panel}</p></article></div><div id="venue-sidebar"><p class="address">{k} Side Street</p></div>
<a class="{button}" href="/button/{k}">Book</a><div class="calendar-modal"><a href="/book/{k}#perf=1">x</a><a href="/book/{k}/">y</a></div><div id="calendar" data-id=" C{k} " data-start=""></div>
<div id="groups"><p>Groups of {size}</p><p> </p><p>Call</p></div>
<div class="feature"><div class="feature-header">How long is it?</div><div class="feature-text">{size} minutes</div></div><div class="feature"><div class="feature-header">Evening times</div><div class="feature-text">at {k}</div></div>
</body></html>""".replace("{{", "{").replace("}}", "}")
SPEC = W.Spec(suffix=" as")


def page_widgets(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """The widgets asked for of a page made for each part."""
    return W.widgets(_part(spark, sf_dir).select(c("p_partkey").alias("part_key"), made(PAGE).alias("html")), "part_key", SPEC, only=only)


def _pairs(rows: Column, *names: str) -> Column:
    """Rows of an array as one text: fields by ``|``, rows by ``;``."""
    return F.array_join(F.transform(rows, lambda x: F.concat_ws("|", *[F.coalesce(x[n].cast("string"), F.lit("")) for n in names])), ";")


def _expect(**columns: str) -> str:
    """SQL: for each part its key and columns; a value is a template, or SQL after ``=``."""
    return "SELECT p_partkey AS part_key, " + ", ".join(f"{v[1:] if v.startswith('=') else said(v)} AS {k}" for k, v in columns.items()) + " FROM part"


@query(_expect(title="{name}", running="{size} min", closing_label="=CASE WHEN p_partkey % 3 = 0 THEN 'Closing date' ELSE 'Booking until' END", closing="=CASE WHEN p_partkey % 3 = 0 THEN concat('End ', p_partkey) ELSE concat('Day ', p_partkey) END"))
def page_titles(spark, sf_dir):
    return page_widgets(spark, sf_dir, "title", "labels", "closing_label", "closing").select("part_key", "title", W.any_case(c("labels"), "RUNNING TIME").alias("running"), "closing_label", "closing")


@query(_expect(people="=CASE WHEN p_partkey % 4 = 0 THEN concat('Writer|Cy ', p_partkey) ELSE concat('Lead|Ann ', p_partkey, ';Fool|Bob') END", cast_list="King|Dee {k};Queen|Eve"))
def page_people(spark, sf_dir):
    return page_widgets(spark, sf_dir, "people", "cast").select("part_key", _pairs(c("people"), "role", "name").alias("people"), _pairs(c("cast"), "role", "name").alias("cast_list"))


@query(_expect(hero="http://img.example/({k}).jpg", gallery="b{k}.jpg,c.jpg", thumbnail="thumb{k}.jpg", duration="{size} minutes", venue="{brand} Hall", venue_url="/venue/{k}/", badge="Musical"))
def page_media(spark, sf_dir):
    return page_widgets(spark, sf_dir, "hero", "gallery", "thumbnail", "duration", "venue", "venue_url", "badge").select("part_key", "hero", F.array_join("gallery", ",").alias("gallery"), "thumbnail", "duration", "venue", "venue_url", "badge")


@query(_expect(description="First of {k}.\n\nSecond of {name}.", access="Wheelchair spaces: {size}", offer_title="Offer {k}", offer="Two for {cents}", running_time="{size} minutes", matinee_text="=NULL::VARCHAR", evening_text="at {k}"))
def page_texts(spark, sf_dir):
    return page_widgets(spark, sf_dir, "description", "access", "offer_title", "offer", "running_time", "matinee_text", "evening_text").select("part_key", "description", F.array_join("access", ";").alias("access"), "offer_title", "offer", "running_time", "matinee_text", "evening_text")


@query(
    _expect(
        weekly="=CASE WHEN p_partkey % 2 = 0 THEN 'Mon||19:30;Tue|14:30|' ELSE 'Mon|14:30|19:30;Tue|14:30|' END",
        last_minute="0|19:30|/p/{k}|{k}|true;2|14:30|/q/{k}||false",
        next_rows="Mon {k}|19:30|/n/{k}",
        months="January|2024|/m/{k}",
        calendar="{day}|19:30|{cents}|{k}|true|/b?a=1&k={k}",
    )
)
def page_schedule(spark, sf_dir):
    w = page_widgets(spark, sf_dir, "weekly", "last_minute", "next_rows", "months", "calendar")
    whole = lambda x: F.transform(x, lambda r: F.struct(r["date"].alias("date"), r["time"].alias("time"), r["min_price"].cast("int").alias("lo"), r["max_price"].cast("int").alias("hi"), r["available"].alias("ok"), F.replace(r["book_url"], F.lit("&amp;"), F.lit("&")).alias("url")))
    return w.select(
        "part_key",
        _pairs(c("weekly"), "day", "matinee", "evening").alias("weekly"),
        _pairs(c("last_minute"), "day", "time", "book_url", "showtime_id", "has_deals").alias("last_minute"),
        _pairs(c("next_rows"), "day", "time", "url").alias("next_rows"),
        _pairs(c("months"), "month", "year", "url").alias("months"),
        _pairs(whole(c("calendar")), "date", "time", "lo", "hi", "ok", "url").alias("calendar"),
    )


@query("SELECT p_partkey AS part_key, CASE p_partkey % 3 WHEN 0 THEN p_partkey::VARCHAR WHEN 2 THEN concat('own', p_partkey) END AS showtime_id FROM part")
def showtime_ids(spark, sf_dir):
    """Numbers from the last-minute table for performances that lack theirs, by address."""
    k = c("part_key")
    w = page_widgets(spark, sf_dir, "last_minute").select("part_key", W.id_by_url(c("last_minute")).alias("ids"))
    url = F.when(k % 3 == 0, F.concat(F.lit("/p/"), k)).otherwise(F.concat(F.lit("/q/"), k))
    own = F.when(k % 3 == 2, F.concat(F.lit("own"), k))
    return w.select("part_key", F.coalesce(own, F.try_element_at("ids", url)).alias("showtime_id"))


@query("SELECT p_partkey AS part_key, nullif(p_partkey % 3, 0)::DOUBLE AS discount, p_partkey::DOUBLE AS min_price, NULL::DOUBLE AS max_price, concat('/book/', p_partkey) AS book_url, '7:30pm' AS time, (10 + p_partkey % 90 + 0.5)::DOUBLE AS price FROM part")
def page_deals(spark, sf_dir):
    return page_widgets(spark, sf_dir, "deals").select("part_key", F.explode("deals").alias("d")).select("part_key", "d.discount", "d.min_price", "d.max_price", "d.book_url", "d.time", "d.price")


# Pages of four kinds: a description under a heading with an element left open, one without such a heading, none at all, and a heading with nothing under it.
_DESCRIBED = (
    '<h1>x</h1><h2>More ABOUT {name}</h2><p>One {k}.</p><div><p>Two <b>{brand}</p></div><h3>Next</h3><p>not</p><div class="description">Whole  {k} <i>text</i></div>',
    '<p>Only {k}</p><div class="description"><p>A{k}</p><p>Read more</p><p>B</p></div>',
    "<h1>{name}</h1>",
    '<div class="description">D{k}</div><h2>more about</h2><h2>Else</h2><p>P{k}',
)


@query(
    _expect(
        under="=CASE p_partkey % 4 WHEN 0 THEN concat('One ', p_partkey, '.', chr(10), chr(10), 'Two ', p_brand) WHEN 1 THEN concat('Only ', p_partkey, chr(10), chr(10), 'A', p_partkey, chr(10), chr(10), 'B') WHEN 3 THEN concat('P', p_partkey) END",
        whole="=CASE p_partkey % 4 WHEN 0 THEN concat('Whole ', p_partkey, ' text') WHEN 1 THEN concat('A', p_partkey, ' Read more B') WHEN 3 THEN concat('D', p_partkey) END",
    )
)
def page_descriptions(spark, sf_dir):
    """The other two ways to find a description, over pages that lack it or hold broken markup."""
    page = F.lit(None)
    for i, template in enumerate(_DESCRIBED):
        page = F.when(c("p_partkey") % 4 == i, made(template)).otherwise(page)
    pages = _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), page.alias("html"))
    each = lambda mode, name: W.widgets(pages, "part_key", W.Spec(description_mode=mode), only=("description",)).withColumnRenamed("description", name)
    return each("after", "under").join(each("whole", "whole"), "part_key")


@query(
    _expect(
        price="=(10 + p_partkey % 90 + 0.25)::DOUBLE", on_offer="=true", booking_period="1 Jan - {day}", address="=CASE WHEN p_partkey % 3 = 0 THEN concat(p_partkey, ' Side Street') ELSE concat(p_partkey, ' Panel Street') END",
        book_url="=CASE WHEN p_partkey % 2 = 0 THEN concat('/button/', p_partkey) ELSE concat('/book/', p_partkey, '/') END", calendar_id="C{k}", calendar_start="=NULL::VARCHAR", group_info="Groups of {size}\n\nCall",
    )
)
def page_booking(spark, sf_dir):
    return page_widgets(spark, sf_dir, "price", "on_offer", "booking_period", "address", "book_url", "calendar_id", "calendar_start", "group_info").select("part_key", "price", "on_offer", "booking_period", "address", "book_url", "calendar_id", "calendar_start", "group_info")


@query(_expect(cards="0|{k}|{name}|/s/{k};2|z|Zed|/z", genres="play,drama", tags="Tag {k}|/tags/slug-{k}/|slug-{k}", category="{brand}"))
def page_cards(spark, sf_dir):
    w = page_widgets(spark, sf_dir, "cards", "tags", "category")
    return w.select("part_key", _pairs(c("cards"), "pos", "key", "title", "url").alias("cards"), F.array_join(c("cards")[0]["genres"], ",").alias("genres"), _pairs(c("tags"), "name", "url", "slug").alias("tags"), "category")


# --- linked data and state

_LD = """<script type="application/ld+json">{bad json</script><script type="application/ld+json">[{"@type":"TheaterEvent","name":"{name}\n\ttabbed","startDate":"{start}","offers":{"price":{zero},"lowPrice":{cents}.5,"priceCurrency":"GBP","availability":"https://schema.org/InStock","url":"/b/{k}"}},
{"@type":"Person","name":"Pat {k}","jobTitle":"Director"},{"@type":"Person","name":"Pat {k}","jobTitle":"Director"},{"@type":"Person","name":"Actor"}]</script>
<script id="x" type="application/ld+json">{"@graph":[{"@type":"Product","name":"{name}","aggregateRating":{"ratingValue":"4.5","ratingCount":{k},"reviewCount":2.5},"offers":{"price":0,"lowPrice":{cents}.25,"priceCurrency":"GBP"}},{"@type":"TheaterEvent","startDate":"2024-02-01"}]}</script>"""
TOKENS |= {"start": "CASE WHEN p_partkey % 5 = 0 THEN '2024-01-11' ELSE concat('2024-01-', 10 + p_partkey % 20, 'T19:30:00+00:00') END", "zero": "CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_partkey END"}


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), H.ld_items(made(_LD)).alias("items"))


@query("SELECT p_partkey AS part_key, concat('2024-01-', 10 + p_partkey % 20) AS date, '19:30' AS time, CASE WHEN p_partkey % 2 = 0 THEN 10 + p_partkey % 90 + 0.5 ELSE p_partkey END::DOUBLE AS price, 'GBP' AS currency, 'https://schema.org/InStock' AS availability, concat('/b/', p_partkey) AS book_url FROM part WHERE p_partkey % 5 <> 0")
def ld_events(spark, sf_dir):
    return _items(spark, sf_dir).select("part_key", F.explode(H.ld_performances(c("items"))).alias("p")).select("part_key", "p.*")


@query(_expect(people="Director|Pat {k}", rating="=4.5::DOUBLE", rating_count="=p_partkey::BIGINT", review_count="=NULL::BIGINT", price="=(10 + p_partkey % 90 + 0.25)::DOUBLE"))
def ld_products(spark, sf_dir):
    r = _items(spark, sf_dir).select("part_key", W.when_empty(F.array().cast("array<struct<role: string, name: string>>"), H.ld_people(c("items"))).alias("people"), H.ld_rating(c("items")).alias("r"))
    return r.select("part_key", _pairs(c("people"), "role", "name").alias("people"), "r.rating", "r.rating_count", "r.review_count", "r.price")


_STATE = """<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"product":{"name":"","displayName":"{name}","venue":{"name":"{brand}"},"previewsFrom":"{day}","fromPrice":{"value":{cents},"currency":"GBP"},"reviewSummary":null},"productElasticSearchData":{"category":{"name":"Plays"},"reviewSummary":{"score":4.5,"reviewsCount":{k}}},
"initialShowtimes":[{"id":{k},"localDate":"{day}","localTime":"19:30","numSeatsAvailable":{seats},"regularTickets":{"lowPrice":{"value":{cents},"currency":"GBP"},"priceBands":[{"price":{"value":{cents}},"numAssignedSeatsAvailable":0},{"price":{"value":99},"numAssignedSeatsAvailable":{size}}]}},{"id":7,"localDate":"{day}","localTime":"14:30","numSeatsAvailable":0,"regularTickets":{"lowPrice":{"value":{cents}},"priceBands":[{"price":{"value":50}}]}}]}}}</script>"""
TOKENS |= {"seats": "p_partkey % 3"}


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    show, showtimes = H.shows_of(c("props"))
    return H.once(_part(spark, sf_dir), "props", H.state_props(H.next_data(made(_STATE)))).select(c("p_partkey").alias("part_key"), show.alias("s"), showtimes.alias("t"))


@query(_expect(name="{name}", category="Plays", venue="{brand}", start_date="{day}", end_date="=NULL::VARCHAR", low_price="=(10 + p_partkey % 90)::DOUBLE", rating="=4.5::DOUBLE", rating_count="=p_partkey::BIGINT", has_promotion="=false"))
def state_shows(spark, sf_dir):
    return _state(spark, sf_dir).select("part_key", *[f"s.{x}" for x in ("name", "category", "venue", "start_date", "end_date", "low_price", "rating", "rating_count", "has_promotion")])


@query(
    "SELECT p_partkey AS part_key, p_partkey::BIGINT AS showtime_id, '19:30' AS local_time, CASE WHEN p_partkey % 3 > 0 THEN 99::DOUBLE END AS low_price, (p_partkey % 3)::INT AS seats_available FROM part UNION ALL SELECT p_partkey, 7, '14:30', (10 + p_partkey % 90)::DOUBLE, 0 FROM part"
)
def state_showtimes(spark, sf_dir):
    return _state(spark, sf_dir).select("part_key", F.explode("t").alias("t")).select("part_key", "t.showtime_id", "t.local_time", "t.low_price", "t.seats_available")


# --- calendars and tables

_CALENDAR = '{"years":{"2024":{"months":{"1":{"days":{"{d}":{"perfs":[{"perf_id":"p{k}","time":"19:30","price":{cents}.5,"seats":{size}},{"perf_id":"q{k}","time":"14:30"}]},"note":{"perfs":[]}}},"meta":{}}},"info":{}}}'
TOKENS |= {"d": "1 + p_partkey % 28"}
_DAY = "'2024-01-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0')"


@query(f"SELECT p_partkey AS part_key, {_DAY} AS date, concat('p', p_partkey) AS perf_id, '19:30' AS time, (10 + p_partkey % 90 + 0.5)::DOUBLE AS price, p_size::INT AS seats FROM part UNION ALL SELECT p_partkey, {_DAY}, concat('q', p_partkey), '14:30', NULL, NULL FROM part")
def calendar_days(spark, sf_dir):
    return H.nested_calendar(_part(spark, sf_dir).select(c("p_partkey").alias("part_key"), made(_CALENDAR).alias("body")), "part_key", "body")


_ANCHORS = '<a href="/shows/seats/cats/a/{k}" data-date="2024-01-10" data-time="19:30">from £{cents}.50</a><a href="/shows/seats/dogs/a/9" data-date="2024-01-10" data-time="19:30">£1</a><a href="/shows/seats/cats/a/0" data-date="2024-01-11" data-time="19:30">£2</a><a href="/shows/seats/cats/a/8" data-date="2024-01-12" data-time="19:30">sold</a><a href="/shows/seats/cats/b/77" data-date="2024-01-1{last}" data-time="19:30">£3</a>'
TOKENS |= {"last": "CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 5 END"}


@query(
    "SELECT p_partkey AS part_key, '2024-01-10' AS date, '19:30' AS time, CASE WHEN p_partkey % 2 = 0 THEN '77' ELSE p_partkey::VARCHAR END AS perf_id, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 10 + p_partkey % 90 + 0.5 END::DOUBLE AS price FROM part UNION ALL SELECT p_partkey, '2024-01-15', '19:30', '77', 3 FROM part WHERE p_partkey % 2 = 1"
)
def calendar_links(spark, sf_dir):
    found = H.once(_part(spark, sf_dir), "anchors", H.calendar_anchors(made(_ANCHORS), "cats"))  # each link is compared with all of them
    rows = found.select(c("p_partkey").alias("part_key"), F.explode(H.last_of_each(c("anchors"))).alias("a"))
    return rows.select("part_key", "a.date", "a.time", "a.perf_id", "a.price")


_TICKETS = '<table><tr class="ticket" data-cost="{cents}"><td>a</td></tr><tr class="big ticket" data-cost="{k}"><td>b</td></tr><tr class="ticket" data-cost="20"><td>Sold out</td></tr><tr class="ticket"><td>no cost</td></tr><tr class="other" data-cost="30"></tr></table>'


@query("SELECT part_key, least(a, b) AS low, greatest(a, b) AS high, n FROM (SELECT p_partkey AS part_key, (10 + p_partkey % 90)::DOUBLE AS a, CASE WHEN p_partkey BETWEEN 4 AND 500 THEN p_partkey END::DOUBLE AS b, CASE WHEN p_partkey BETWEEN 4 AND 500 THEN 2 ELSE 1 END::INT AS n FROM part)")
def ticket_tiers(spark, sf_dir):
    tiers = prices.ticket_tiers(made(_TICKETS))
    return _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), F.array_min(tiers).alias("low"), F.array_max(tiers).alias("high"), F.size(tiers).alias("n"))


@query("SELECT p_partkey AS part_key, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS available FROM part")
def stock_states(spark, sf_dir):
    states = F.expr("case p_partkey % 4 when 0 then array('https://schema.org/InStock') when 1 then array('OutOfStock', 'x/InStock') when 2 then array('', 'https://schema.org/SoldOut') else array('PreOrder') end")
    return _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), prices.stock_state(states).alias("available"))


_EVENT = "<script>fireCrmEvent('Viewed Performance', {'min_price': {cents}.5, \"max_price\": {k}, 'is_discounted': true, 'is_no_booking_fee': {flag}, 'other': 'x'});</script>"
TOKENS |= {"flag": "CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END"}


@query("SELECT p_partkey AS part_key, (10 + p_partkey % 90 + 0.5)::DOUBLE AS min_price, p_partkey::DOUBLE AS max_price, NULL::DOUBLE AS price, true AS is_discounted, p_partkey % 2 = 0 AS is_no_booking_fee FROM part WHERE p_partkey % 7 <> 0")
def tracking_events(spark, sf_dir):
    page = F.when(c("p_partkey") % 7 != 0, made(_EVENT)).otherwise("<p>none</p>")
    return _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), H.tracking_event(page).alias("e")).where("e is not null").select("part_key", "e.*")


_PLAN = '{"ResultCode":"{size}","data":{"Performances":[{"SeatIdOnMap":"a"},{"SeatIdOnMap":"b"}],"PriceBands":[{"MclId":"1","Price":"£{cents}.50","FaceValue":"£{cents}"},{"MclId":"2","Price":"£1,200"},{"MclId":"3","Price":"{cents}.50"},{"MclId":"4","Price":"£5"}]}}'


@query("SELECT p_partkey AS part_key, p_size::VARCHAR AS result_code, 5::DOUBLE AS low, (10 + p_partkey % 90 + 0.5)::DOUBLE AS high, 2::INT AS n_tiers, (10 + p_partkey % 90)::DOUBLE AS face, 2::INT AS seats FROM part WHERE p_partkey % 6 <> 0")
def seat_plans(spark, sf_dir):
    plan = H.seat_plan(F.when(c("p_partkey") % 6 != 0, made(_PLAN)).otherwise("[1]"))
    rows = _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), plan.alias("s")).where("s is not null")
    return rows.select("part_key", "s.result_code", F.array_min("s.tiers").alias("low"), F.array_max("s.tiers").alias("high"), F.size("s.tiers").alias("n_tiers"), c("s.face_tiers")[0].alias("face"), "s.seats")


@query("SELECT p_partkey AS part_key, CASE WHEN p_partkey % 2 = 0 THEN 10 + p_partkey % 90 + 0.5 END::DOUBLE AS first_price, (10 + p_partkey % 90 + 0.5)::DOUBLE AS with_comma, least(10 + p_partkey % 90 + 0.5, 25)::DOUBLE AS low, greatest(10 + p_partkey % 90 + 0.5, 25)::DOUBLE AS high FROM part")
def pound_prices(spark, sf_dir):
    """A decimal comma is a price to the scan, and none where only a point counts."""
    shown = made("from £{cents}{mark}50 or £25, £25 and £900")
    found = prices.all_pound_prices(shown)
    return _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), prices.pound_price(shown).alias("first_price"), prices.pound_price(shown, True).alias("with_comma"), F.array_min(found).alias("low"), F.array_max(found).alias("high"))


TOKENS |= {"mark": "CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE ',' END"}

# --- texts and addresses


@query("SELECT p_partkey AS part_key, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('Tom & ', p_name, ' <b>') END AS decoded, concat('The ', p_name) AS stem, CASE WHEN p_partkey % 2 = 0 THEN concat(p_brand, ' Hall') END AS venue, concat('Closing ', p_partkey) AS closing, NULL::VARCHAR AS opens FROM part")
def text_bits(spark, sf_dir):
    coded = F.when(c("p_partkey") % 3 == 0, " &nbsp; ").otherwise(made(" Tom &amp;amp; {name} &lt;b&gt; "))
    venue = F.when(c("p_partkey") % 2 == 0, made(" {brand} Hall , London\nsecond")).otherwise(" , x")
    notices = made("opening late\nClosing never\n closing\nClosing {k}")
    return _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), text.unescape_html(coded).alias("decoded"), text.without_suffix(made("The {name} as"), " as").alias("stem"), text.venue_first_part(venue).alias("venue"), text.notice(notices, "closing").alias("closing"), text.notice(notices, "opens").alias("opens"))


@query("SELECT p_partkey AS part_key, 'A bold claim and link' AS first_paragraph, p_name AS last_paragraph, 3::INT AS n FROM part")
def markdown_paragraphs(spark, sf_dir):
    p = text.paragraphs(made("## A **bold** *claim*\nand [link](/x)\r\n\r\n \n\nmiddle\n\n\n{name}  "))
    return _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), p[0].alias("first_paragraph"), F.element_at(p, -1).alias("last_paragraph"), F.size(p).alias("n"))


@query("SELECT p_partkey AS part_key, concat('https://x.example/caf%C3%A9/', p_partkey, '%20b?q=%C3%BC') AS url, p_partkey::BIGINT AS id, concat('name-', p_size) AS slug, p_partkey::VARCHAR AS perf FROM part")
def url_parts(spark, sf_dir):
    own = urls.id_and_slug(made("https://x.example/shows/{k}-name-{size}/?a=1"))
    return _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), urls.ascii_safe(made("https://x.example/café/{k}%20b?q=ü")).alias("url"), own[0].alias("id"), own[1].alias("slug"), urls.fragment_id(made("https://x.example/book/#perf={k}")).alias("perf"))


@query(
    "SELECT o_orderkey, concat('https://s.example/show/tickets/', day(o_orderdate), lower(strftime(o_orderdate, '-%b-%Y')), '/', CASE WHEN o_orderkey % 24 % 12 = 0 THEN 12 ELSE o_orderkey % 24 % 12 END, '-', lpad((o_orderkey % 60)::VARCHAR, 2, '0'), CASE WHEN o_orderkey % 24 < 12 THEN 'am' ELSE 'pm' END, '/') AS page, CASE WHEN o_orderkey % 3 <> 0 THEN concat('https://t.example/?product_id=', o_custkey, '&qt=2&showtime_id=', o_orderkey, '&date=', strftime(o_orderdate, '%Y-%m-%d'), '&slot=', lpad((o_orderkey % 24)::VARCHAR, 2, '0'), '%3A', lpad((o_orderkey % 60)::VARCHAR, 2, '0')) END AS booking FROM orders"
)
def booking_urls(spark, sf_dir):
    day = c("o_orderdate").cast("date")
    time = F.format_string("%02d:%02d", c("o_orderkey") % 24, c("o_orderkey") % 60)
    showtime = F.when(c("o_orderkey") % 3 != 0, c("o_orderkey"))
    return A.read(spark, sf_dir, "orders").select("o_orderkey", urls.ticket_page(F.lit("https://s.example/show"), day, time).alias("page"), urls.booking_query("https://t.example/", c("o_custkey"), showtime, day, time).alias("booking"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':15' END AS time, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 5 = 1 THEN 'late' ELSE lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':05' END END AS canonical FROM orders"
)
def time_texts(spark, sf_dir):
    h = c("o_orderkey") % 24
    iso = F.when(c("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string("T%02d:15:00+05:00", h))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    date, time = times.iso_split(iso)
    loose = F.when(c("o_orderkey") % 5 == 0, "").when(c("o_orderkey") % 5 == 1, "late").otherwise(F.format_string("%d:05", h))
    return A.read(spark, sf_dir, "orders").select("o_orderkey", date.alias("date"), time.alias("time"), times.canonical_time(loose).alias("canonical"))


@query("SELECT p_partkey AS part_key, concat(p_size, ' Street') AS street, NULL::VARCHAR AS city, p_brand AS category, concat('/c/', p_partkey) AS canonical FROM part")
def address_keys(spark, sf_dir):
    m = F.create_map(F.lit("StreetAddress"), made("{size} Street"), F.lit("ADDRESSLOCALITY"), F.lit(""))
    item = lambda p, n, u: F.struct(p.alias("position"), n.alias("name"), u.alias("url"))
    crumbs = F.array(item(F.lit(None).cast("int"), F.lit("late"), F.lit("/category/z")), item(F.lit(2), c("p_brand"), F.lit("/category/a")), item(F.lit(1), F.lit("Home"), F.lit("/")))
    return _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), W.any_case(m, "streetaddress").alias("street"), W.any_case(m, "AddressLocality").alias("city"), W.crumb_category(crumbs).alias("category"), W.canonical_url(made("/c/{k}"), F.lit("/own")).alias("canonical"))


@query("SELECT p_partkey AS part_key, p_size::VARCHAR AS venue_id, concat(lpad((1 + p_partkey % 28)::VARCHAR, 2, '0'), '/01/2024') AS day, '19-30' AS time FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0")
def seat_requests(spark, sf_dir):
    day = F.when(c("p_partkey") % 3 != 0, F.format_string("2024-01-%02d", 1 + c("p_partkey") % 28))
    venue = F.when(c("p_partkey") % 4 != 0, made("https://x.example/venues/{size}/hall")).otherwise("https://x.example/none")
    rows = _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), W.seat_request(c("p_partkey"), F.lit(1), venue, day, F.lit("19:30")).alias("r")).where("r is not null")
    return rows.select("part_key", c("r.VenueId").alias("venue_id"), c("r.PDate").alias("day"), c("r.Time").alias("time"))


@query("SELECT p_partkey AS part_key, CASE p_partkey % 5 WHEN 0 THEN 1 ELSE 0 END::INT AS cards, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat(p_brand, ' Hall') END AS venue, CASE p_partkey % 3 WHEN 0 THEN '12+' WHEN 1 THEN 'all ages' ELSE 'under 5' END AS age FROM part")
def fragments(spark, sf_dir):
    """Answers of a fragment service: only a good one with cards has any."""
    k = c("p_partkey") % 5
    body = F.when(k == 2, "[1]").when(k == 3, '{"html": 5}').when(k == 4, '{"html": " "}').otherwise(made('{"total":1,"html":"<article class=\\"card\\" data-id=\\"{k}\\"><h2>x</h2></article>"}'))
    pages = _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), W.fragment_html(F.when(k == 1, 500).otherwise(200), F.lit("Application/JSON"), body).alias("html"))
    venues = F.when(c("p_partkey") % 3 == 0, F.array(F.lit(" , a"), F.lit(""))).otherwise(F.array(F.lit(","), made("{brand} Hall, London"), F.lit("Other")))
    age = F.expr("case p_partkey % 3 when 0 then 'Ages 12+ only' when 1 then 'For ALL AGES' else 'Not for Under 5s' end")
    rest = _part(spark, sf_dir).select(c("p_partkey").alias("part_key"), W.first_venue(venues).alias("venue"), H.age_label(age).alias("age"))
    return W.widgets(pages, "part_key", SPEC, only=("cards",)).select("part_key", F.size("cards").alias("cards")).join(rest, "part_key")


@query("SELECT conv_id, i::INT AS i, r[i] AS role, t[i + 1] AS next_role FROM (SELECT conv_id, list(role ORDER BY turn) AS r, list(role ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id), unnest(range(1, n + 1)) x(i)")
def zipped_lists(spark, sf_dir):
    """Two lists by place, the second one shorter by one: what is missing is null."""
    rows = A.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    z = rows.select("conv_id", F.posexplode(M.zipped(c("r"), F.slice("r", F.lit(2), F.size("r")))).alias("p", "x"))
    return z.select("conv_id", (c("p") + 1).alias("i"), c("x.first").alias("role"), c("x.second").alias("next_role"))


# --- widgets of pages as they are found

#: Where the widgets of the test tables' pages are.
FOUND = W.Spec(tags="a[href]", breadcrumb="nav", description="footer", description_mode="whole", group_info="div.ad")
_BARE = "regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
_DECODED = {"copy": "©", "middot": "·", "quot": '"', "amp": "&"}


def _plain(text: str) -> str:
    """SQL: a piece of markup without tags as text; null if none is left."""
    out = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, sign in _DECODED.items():
        out = f"regexp_replace({out}, '&{name};?', '{sign}', 'g')"
    return f"nullif(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '')"


def _inside(start: str, tag: str) -> str:
    return f"regexp_extract({_BARE}, '(?s)<{start}>(.*?)</{tag}>', 1)"


_A = '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'


@query(
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(b, '{_A}', 1)) AS url, unnest(regexp_extract_all(b, '{_A}', 2)) AS name, generate_subscripts(regexp_extract_all(b, '{_A}', 1), 1) AS n FROM (SELECT page_id, {_BARE} AS b FROM pages)),
g AS (SELECT page_id, string_agg(concat(coalesce({_plain("name")}, ''), '|', {_plain("url")}, '|', nullif(regexp_extract({_plain("url")}, '([^/]*)/*$', 1), '')), ';' ORDER BY n) AS links FROM l GROUP BY page_id),
m AS (SELECT page_id, list_filter(list_transform(regexp_extract_all({_inside("nav", "nav")}, '{_A}', 2), lambda x: {_plain("x")}), lambda x: lower(x) NOT IN ('home', 'shows')) AS menu FROM pages)
SELECT p.page_id AS page_id, {_plain(_inside("h1", "h1"))} AS title, menu[-1] AS category, coalesce(links, '') AS links, {_plain(_inside("footer", "footer"))} AS note, {_plain(_inside('div class="ad"', "div"))} AS ad
FROM pages p JOIN m ON p.page_id = m.page_id LEFT JOIN g ON p.page_id = g.page_id"""
)
def found_widgets(spark, sf_dir):
    """Heading, last menu entry, links, note and advertisement of every page of the table."""
    pages = A.read(spark, sf_dir, "pages").repartition(spark.sparkContext.defaultParallelism, "page_id")
    w = W.widgets(pages, "page_id", FOUND, only=("title", "category", "tags", "description", "group_info"))
    return w.select("page_id", "title", "category", _pairs(c("tags"), "name", "url", "slug").alias("links"), c("description").alias("note"), c("group_info").alias("ad"))
