"""Facts from HTML: by built-in regular expressions where a page is simple, and by
a tolerant parser of the standard library in Arrow batches where widgets nest."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values here and below: patterns and names that sellers' pages have.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is made once for each row. Spark puts what a
    column is made of into each place that names it, but not across a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def heading(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1), F.lit(""))


def language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'<html[^>]* lang="([^"]*)"', 1), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), 1)


def background_image(style: Column) -> Column:
    """The address in ``url(...)``; brackets inside count where it is quoted."""
    quoted = F.regexp_extract(style, r"url\(\s*(?:'([^']*)'|\"([^\"]*)\")\s*\)", 0)
    inside = F.regexp_replace(quoted, r"^url\(\s*['\"]|['\"]\s*\)$", "")
    return F.nullif(F.when(quoted != "", inside).otherwise(F.regexp_extract(style, r"url\(\s*([^'\")]+?)\s*\)", 1)), F.lit(""))


def age_label(text: Column) -> Column:
    """``14+``, ``all ages`` or ``under 5``, in lower case."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)(\d{1,2}\+|all ages|under \d{1,2})", 1)), F.lit(""))


def json_ld(html: Column) -> Column:
    """The texts of all linked-data scripts, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)


_LD_ITEM = "`@type`: string, name: string, startDate: string, jobTitle: string, url: string, location: struct<name: string>, offers: struct<price: double, lowPrice: double, priceCurrency: string, availability: string, url: string>, aggregateRating: struct<ratingValue: string, ratingCount: string, reviewCount: string>"
LD_SCHEMA = f"array<struct<{_LD_ITEM}, `@graph`: array<struct<{_LD_ITEM}>>>>"


def ld_items(html: Column) -> Column:
    """The items of all linked-data scripts as one array: lists are flattened,
    graphs opened, single items taken as they are, scripts that aren't JSON left out; raw control characters do no harm."""
    listed = F.transform(json_ld(html), lambda s: F.when(F.ltrim(s).startswith("["), s).otherwise(F.concat(F.lit("["), s, F.lit("]"))))
    parsed = F.transform(listed, lambda s: F.from_json(s, LD_SCHEMA, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}))
    whole = F.filter(F.flatten(F.filter(parsed, lambda x: x.isNotNull())), lambda x: x.isNotNull())
    names = ("@type", "name", "startDate", "jobTitle", "url", "location", "offers", "aggregateRating")
    plain = lambda x: F.struct(*[x[n].alias(n) for n in names])
    items = F.flatten(F.transform(whole, lambda x: F.when(x["@graph"].isNotNull(), F.transform(x["@graph"], plain)).otherwise(F.array(plain(x)))))
    return F.filter(items, lambda x: x.isNotNull() & x["@type"].isNotNull())


def ld_of_type(items: Column, kind: str) -> Column:
    return F.filter(items, lambda x: x["@type"] == kind)


def ld_performances(items: Column) -> Column:
    """Theatre events with a time as performances: date and time as written, price, currency, availability, address."""
    events = F.filter(ld_of_type(items, "TheaterEvent"), lambda e: e["startDate"].contains("T"))
    return F.transform(events, lambda e: F.struct(F.substring(e["startDate"], 1, 10).alias("date"), F.substring(F.split_part(e["startDate"], F.lit("T"), F.lit(2)), 1, 5).alias("time"), F.coalesce(F.nullif(e["offers"]["price"], F.lit(0.0)), e["offers"]["lowPrice"]).alias("price"), e["offers"]["priceCurrency"].alias("currency"), e["offers"]["availability"].alias("availability"), e["offers"]["url"].alias("book_url")))


def ld_people(items: Column) -> Column:
    """Role and name of people with a job, each pair once and in order."""
    jobs = F.filter(ld_of_type(items, "Person"), lambda p: F.coalesce(p["jobTitle"] != "", F.lit(False)))
    return F.array_distinct(F.transform(jobs, lambda p: F.struct(p["jobTitle"].alias("role"), p["name"].alias("name"))))


def ld_rating(items: Column) -> Column:
    """The first product's rating, its counts where they are whole numbers, and its price (the lowest one where that is missing or 0)."""
    product = F.try_element_at(ld_of_type(items, "Product"), F.lit(1))
    rating, offers = product["aggregateRating"], product["offers"]
    whole = lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]+$")), x.try_cast("long"))
    fields = {"rating": rating["ratingValue"].try_cast("double"), "rating_count": whole(rating["ratingCount"]), "review_count": whole(rating["reviewCount"]), "price": F.coalesce(F.nullif(offers["price"], F.lit(0.0)), offers["lowPrice"]), "currency": offers["priceCurrency"]}
    return F.when(product.isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


_PRICE = "struct<value: double, display: string, currency: string>"
STATE = (
    "struct<props: struct<pageProps: struct<product: struct<name: string, displayName: string, category: struct<name: string>, venue: struct<name: string>, startingDate: string, previewsFrom: string, closingDate: string, bookingTo: string, "
    f"fromPrice: {_PRICE}, hasPromotion: boolean, promotion: struct<label: string>, reviewSummary: struct<score: double, reviewsCount: long>, shortDescription: string, about: string>, "
    "productElasticSearchData: struct<category: struct<name: string>, reviewSummary: struct<score: double, reviewsCount: long>>, "
    "initialShowtimes: array<struct<id: long, datetime: string, localDate: string, localTime: string, dayOfWeek: string, daypart: string, numSeatsAvailable: int, "
    f"regularTickets: struct<lowPrice: {_PRICE}, hasPromotion: boolean, promotionLabel: string, priceBands: array<struct<price: {_PRICE}, numAssignedSeatsAvailable: int>>>>>>>>"
)


def state_props(blob: Column) -> Column:
    """What the state text holds, parsed."""
    return F.from_json(blob, STATE)["props"]["pageProps"]


def state_shows(blob: Column) -> tuple[Column, Column]:
    """A show and its showtimes from the state text (``shows_of``)."""
    return shows_of(state_props(blob))


def shows_of(props: Column) -> tuple[Column, Column]:
    """A show and its showtimes from the parsed state: what the product lacks comes
    from the search data, and a showtime's price is that of its cheapest open band
    (``verify.band_low_price``). Each field names ``props`` anew, so ``props``
    should be a column of the table (``once``) and no parsing of its own."""
    from ..operators.verify import band_low_price

    p, search = props["product"], props["productElasticSearchData"]
    text = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])
    review = F.coalesce(p["reviewSummary"], search["reviewSummary"])
    show = {
        "name": text(p["name"], p["displayName"]), "category": F.coalesce(p["category"]["name"], search["category"]["name"]), "venue": p["venue"]["name"], "start_date": text(p["startingDate"], p["previewsFrom"]), "end_date": text(p["closingDate"], p["bookingTo"]),
        "low_price": p["fromPrice"]["value"], "currency": p["fromPrice"]["currency"], "has_promotion": F.coalesce(p["hasPromotion"], F.lit(False)), "promotion": p["promotion"]["label"], "rating": review["score"], "rating_count": review["reviewsCount"], "description": text(p["shortDescription"], p["about"]),
    }

    def showtime(s: Column) -> Column:
        tickets = s["regularTickets"]
        bands = F.transform(tickets["priceBands"], lambda b: F.struct(b["price"]["value"].alias("price_value"), b["numAssignedSeatsAvailable"].alias("seats_available")))
        low = band_low_price(bands, tickets["lowPrice"]["value"], s["numSeatsAvailable"])
        return F.struct(s["id"].alias("showtime_id"), s["localDate"].alias("local_date"), s["localTime"].alias("local_time"), low.alias("low_price"), tickets["lowPrice"]["currency"].alias("currency"), F.coalesce(tickets["hasPromotion"], F.lit(False)).alias("has_promotion"), s["numSeatsAvailable"].alias("seats_available"))

    return F.when(p.isNotNull(), F.struct(*[v.alias(k) for k, v in show.items()])), F.coalesce(F.transform(props["initialShowtimes"], showtime), F.array().cast("array<struct<showtime_id: bigint, local_date: string, local_time: string, low_price: double, currency: string, has_promotion: boolean, seats_available: int>>"))


def next_data(html: Column) -> Column:
    """The text of the page's state script."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def calendar_anchors(html: Column, show: str) -> Column:
    """Priced calendar links of one show as (pos, date, time, perf_id, price): other shows' and placeholder links are left out."""
    pattern = rf'href="(/shows/seats/{show}/[^"]*?/(\d+))"[^>]*data-date="(\d{{4}}-\d{{2}}-\d{{2}})"[^>]*data-time="(\d{{2}}:\d{{2}})"[^>]*>[^<]*£([0-9]+(?:\.[0-9]+)?)'
    part = lambda i: F.regexp_extract_all(html, F.lit(pattern), i)
    rows = F.arrays_zip(part(2).alias("perf_id"), part(3).alias("date"), part(4).alias("time"), part(5).alias("price"))
    return F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("pos"), x["date"].alias("date"), x["time"].alias("time"), x["perf_id"].alias("perf_id"), x["price"].try_cast("double").alias("price"))), lambda x: x["perf_id"] != "0")


def last_of_each(anchors: Column) -> Column:
    """Of anchors with the same date and time, the last one."""
    return F.filter(anchors, lambda a: ~F.exists(anchors, lambda b: (b["date"] == a["date"]) & (b["time"] == a["time"]) & (b["pos"] > a["pos"])))


def tracking_event(html: Column) -> Column:
    """The numbers and marks of a page's ``Viewed Performance`` call; null without it."""
    body = F.regexp_extract(html, r"(?s)fireCrmEvent\(\s*['\"]Viewed Performance['\"]\s*,\s*\{([^}]*)\}", 1)
    number = lambda k: F.regexp_extract(body, rf"['\"]{k}['\"]\s*:\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    mark = lambda k: F.nullif(F.regexp_extract(body, rf"['\"]{k}['\"]\s*:\s*(true|false)\b", 1), F.lit("")) == "true"
    fields = [number(k).alias(k) for k in ("min_price", "max_price", "price")] + [mark(k).alias(k) for k in ("is_discounted", "is_no_booking_fee")]
    return F.when(body != "", F.struct(*fields))


SEAT_PLAN = "struct<ResultCode: string, data: struct<Performances: array<struct<SeatIdOnMap: string, MclId: string>>, PriceBands: array<struct<MclId: string, Price: string, FaceValue: string>>>>"


def seat_plan(body: Column, low: float = 4.0, high: float = 500.0) -> Column:
    """A seat plan's code, distinct ascending price tiers within bounds (selling
    and face value), and seats; null for what isn't a JSON object."""
    from ..functions.prices import parse_money

    plan = F.from_json(body, SEAT_PLAN)
    tiers = lambda field: F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(plan["data"]["PriceBands"], lambda b: parse_money(b[field])), lambda x: (x >= low) & (x <= high)))), F.array().cast("array<double>"))
    return F.when(F.ltrim(body).startswith("{") & plan["ResultCode"].isNotNull(), F.struct(plan["ResultCode"].alias("result_code"), tiers("Price").alias("tiers"), tiers("FaceValue").alias("face_tiers"), F.greatest(F.size(plan["data"]["Performances"]), F.lit(0)).alias("seats")))


def nested_calendar(df: DataFrame, key: str, body: str, perf: str = "perf_id: string, time: string, price: double, seats: int") -> DataFrame:
    """A row (key, date, and the fields of ``perf``) for each performance of
    ``years.Y.months.M.days.D.perfs``; keys that aren't numbers, which hold marks, are passed over."""

    def level(rows: DataFrame, name: str, digits: str, keep: list[str]) -> DataFrame:
        found = F.from_json("v", f"struct<{name}: map<string, string>>")[name]
        return rows.select(*keep, F.explode(found).alias(f"{name}_key", "v")).where(F.col(f"{name}_key").rlike(digits))

    rows = level(df.select(key, F.col(body).alias("v")), "years", "^[0-9]{4}$", [key])
    rows = level(rows, "months", "^[0-9]{1,2}$", [key, "years_key"])
    rows = level(rows, "days", "^[0-9]{1,2}$", [key, "years_key", "months_key"])
    date = F.concat_ws("-", "years_key", F.lpad("months_key", 2, "0"), F.lpad("days_key", 2, "0"))
    perfs = F.from_json("v", f"struct<perfs: array<struct<{perf}>>>")["perfs"]
    return rows.select(key, date.alias("date"), F.explode(perfs).alias("p")).select(key, "date", "p.*")


class _Page(HTMLParser):
    """Collects what pages and widgets need in one pass: first heading, language,
    links with their texts, paragraphs, images, tables' rows, and linked data. A page
    given ``as_written`` has each ampersand coded once more, so that texts and
    attributes come out as they stand in it; scripts are never decoded."""

    def __init__(self, as_written: bool = False):
        super().__init__(convert_charrefs=True)
        self.as_written = as_written
        self.lang = self.h1 = self.canonical = self.state = None
        self.links, self.paragraphs, self.images, self.rows, self.ld = [], [], [], [], []
        self.open: list[tuple[str, list[str]]] = []
        self.href: str | None = None
        self.script: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang") or self.lang
        elif tag == "link" and a.get("rel") == "canonical":
            self.canonical = a.get("href")
        elif tag == "img" and (a.get("data-src") or a.get("src")):
            src = a.get("data-src") or a.get("src")
            if src not in self.images:
                self.images.append(src)
        elif tag in ("script", "style"):
            self.script = "ld" if a.get("type") == "application/ld+json" else "state" if a.get("id") == "__NEXT_DATA__" else ""
        if tag == "tr":
            self.rows.append([])
        if tag == "a":
            self.href = a.get("href")
        if tag in ("h1", "p", "a", "td", "th"):
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.script = None
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        text = "".join(self.open[at][1])
        text = re.sub(r"[ \t\n\f\r]+", " ", text).strip(" ") if self.as_written else " ".join(text.split())
        self.open = self.open[:at]
        if tag == "h1" and self.h1 is None:
            self.h1 = text or None
        elif tag == "p" and text:
            self.paragraphs.append(text)
        elif tag == "a" and self.href is not None:
            self.links.append((self.href, text))
            self.href = None
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(None if text in ("", "-") else text)

    def handle_data(self, data):
        if self.script and self.as_written:
            data = data.replace("&amp;", "&")
        if self.script == "ld":
            self.ld.append(data)
        elif self.script == "state":
            self.state = data
        elif self.script is None:
            for _, texts in self.open:
                texts.append(data)


PAGE_SCHEMA = "h1 string, lang string, canonical string, links array<struct<href: string, text: string>>, paragraphs array<string>, images array<string>, rows array<array<string>>, ld array<string>"


def parse_page(html: str | None, as_written: bool = False) -> dict:
    p = _Page(as_written)
    if html:
        p.feed(html.replace("&", "&amp;") if as_written else html)
        p.close()
    ld = []
    for block in p.ld:
        try:
            found = json.loads(block, strict=False)
        except ValueError:
            continue
        ld += [json.dumps(x) for x in (found if isinstance(found, list) else [found])]
    return {"h1": p.h1, "lang": p.lang, "canonical": p.canonical, "links": [{"href": h, "text": t} for h, t in p.links], "paragraphs": p.paragraphs, "images": p.images, "rows": p.rows, "ld": ld}


def parse_pages(pages: DataFrame, key: str, html: str = "html", as_written: bool = False) -> DataFrame:
    """Each page's facts under its key, by the parser; a null page has none.
    Entities are decoded, or left ``as_written``."""
    kind = pages.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([parse_page(x if isinstance(x, str) else None, as_written) for x in batch[html]])
            out.insert(0, key, batch[key].to_numpy())
            yield out

    return pages.select(key, html).mapInPandas(rows, f"{key} {kind}, {PAGE_SCHEMA}")
