"""Widgets of listing and detail pages.

``tree`` reads a page into nodes with the standard library's parser; a ``Spec``
says where a source keeps its widgets (tags, classes, attributes), and
``widgets`` turns pages into rows by it, in Arrow batches. Sources differ in
their specs, not in code.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .html import VOID


class Node:
    """An element: tag, attributes, and children (nodes and texts). ``page`` holds all
    nodes of its page in order; those below it are the ones from ``at + 1`` to before ``upto``."""

    __slots__ = ("tag", "_attrs", "children", "parent", "page", "at", "upto")

    def __init__(self, tag: str, attrs: dict | str, parent: Node | None = None):
        self.tag, self._attrs, self.children, self.parent = tag, attrs, [], parent
        self.page = page = parent.page if parent else Page()
        self.at, self.upto = len(page.nodes), None
        page.nodes.append(self)

    @property
    def attrs(self) -> dict:
        """The attributes, read from plain markup when they are first asked for."""
        if isinstance(self._attrs, str):
            self._attrs = _attrs(self._attrs)
        return self._attrs

    def may_say(self, name: str) -> bool:
        """Whether the attributes could hold a name: cheaper than reading them."""
        return not isinstance(self._attrs, str) or name in self._attrs or "&" in self._attrs

    def walk(self) -> list[Node]:
        return self.page.nodes[self.at : self.upto]

    def texts(self) -> Iterator[str]:
        """Texts below in the order of the page, scripts and styles aside; any depth of nesting."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                stack += reversed(x.children)

    def text(self, joint: str = " ") -> str:
        return " ".join(joint.join(self.texts()).split())

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def all(self, where: str) -> list[Node]:
        """Nodes below that fit ``tag.class#id[attr]`` (any part may be missing)."""
        tag, wanted = _selector(where)
        return [n for n in self.page.kin(self, tag) if all(f(n) for f in wanted)]

    def one(self, where: str) -> Node | None:
        tag, wanted = _selector(where)
        return next((n for n in self.page.kin(self, tag) if all(f(n) for f in wanted)), None)

    def within(self, path: str) -> list[Node]:
        """Nodes below that fit the last part of ``a b c`` inside ones that fit the parts before it."""
        found = [self]
        for part in path.split():
            found = list(dict.fromkeys(x for n in found for x in n.all(part)))
        return found


class Page:
    """The nodes of a page in order, and the places of those of each tag."""

    __slots__ = ("nodes", "tags")

    def __init__(self):
        self.nodes: list[Node] = []
        self.tags: dict[str, list[int]] | None = None

    def kin(self, node: Node, tag: str) -> Iterator[Node]:
        """Nodes below a node, of one tag or (empty) of any."""
        if not tag:
            return iter(self.nodes[node.at + 1 : node.upto])
        if self.tags is None:
            self.tags = defaultdict(list)
            for n in self.nodes:
                self.tags[n.tag].append(n.at)
        at = self.tags.get(tag, [])
        upto = len(at) if node.upto is None else bisect_left(at, node.upto)
        return (self.nodes[i] for i in at[bisect_left(at, node.at + 1) : upto])


    def unlink(self) -> None:
        """Parts the nodes from each other, so that they go at once and need no search for circles."""
        for n in self.nodes:
            n.parent = None
        self.nodes.clear()


@lru_cache(1024)
def _selector(where: str) -> tuple[str, list[Callable[[Node], bool]]]:
    tag = re.match(r"[a-z0-9]*", where)[0]
    wanted: list[Callable[[Node], bool]] = []
    for kind, name in re.findall(r"([.#\[])([\w:-]+)\]?", where[len(tag) :]):
        if kind == ".":
            wanted.append(lambda n, x=name: n.may_say(x) and x in n.classes)
        elif kind == "#":
            wanted.append(lambda n, x=name: n.may_say(x) and n.attrs.get("id") == x)
        else:
            wanted.append(lambda n, x=name: n.may_say(x) and x in n.attrs)
    return tag, wanted


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
        else:
            node.upto = node.at + 1

    def handle_startendtag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        node.upto = node.at + 1
        self.at.children.append(node)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:  # a stray end tag closes nothing
            self.close_to(n.parent)

    def close_to(self, n: Node) -> None:
        """Ends all open nodes below ``n``."""
        while self.at is not n:
            self.at.upto = len(n.page.nodes)
            self.at = self.at.parent

    def handle_data(self, data):
        self.at.children.append(data)


_ATTRS = r'((?:[ \t\n]+[a-z][a-z0-9-]*(?:="[^"]*")?)*)[ \t\n]*'
#: Markup that any parser reads alike: texts, tags whose attributes stand in double quotes, scripts and styles, and the page's type; and the start of any other.
_PLAIN = re.compile(rf'([^<]+)|</([a-z][a-z0-9]*)>|<(?!script|style)([a-z][a-z0-9]*){_ATTRS}>|<(script|style){_ATTRS}>([^<]*(?:<(?!/|!)[^<]*|</(?!(?i:\5))[^<]*)*)</\5>|<!DOCTYPE [a-zA-Z ]*>|(<)')
_ATTR = re.compile(r'([a-z][a-z0-9-]*)(="[^"]*")?')


def _attrs(text: str) -> dict[str, str | None]:
    found = {k: v[2:-1] if v else None for k, v in _ATTR.findall(text)}
    return {k: v and unescape(v) for k, v in found.items()} if "&" in text else found


def _plain_tree(html: str) -> Node | None:
    """A page all of plain markup as nodes, some times faster than by the standard parser; None for any other."""
    b = _Builder()
    at = b.root
    nodes = at.page.nodes
    for text, end, tag, attrs, kind, about, code, other in _PLAIN.findall(html):
        if text:
            at.children.append(unescape(text) if "&" in text else text)
        elif tag:
            node = Node(tag, attrs, at)
            at.children.append(node)
            if tag in VOID:
                node.upto = node.at + 1
            else:
                at = node
        elif end:
            if at.tag == end:
                at.upto, at = len(nodes), at.parent
            else:
                b.at = at
                b.handle_endtag(end)
                at = b.at
        elif kind:
            node = Node(kind, about, at)
            at.children.append(node)
            node.children, node.upto = [code] if code else [], node.at + 1
        elif other:
            return None
    return b.root


def tree(html: str | None) -> Node:
    plain = _plain_tree(html or "")
    if plain is not None:
        return plain
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


PRICE, TIME = re.compile(r"£\s*([0-9]+(?:[.,][0-9]{1,2})?)"), re.compile(r"\b(\d{1,2}[:.]\d{2}\s*(?:am|pm)?|\d{1,2}\s*(?:am|pm))\b", re.I)


def number(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


def filled(text: str | None) -> str | None:
    return text if text and text != "-" else None


@dataclass(frozen=True)
class Spec:
    """Where a source keeps its widgets; an empty place means that it has none."""

    card: str = "article.card"
    card_key: str = "data-id"
    title: str = "h1"
    title_mode: str = "first"  # the heading's first text, or "whole"
    info: tuple[str, str, str] = ("div.info", "dt", "dd")
    people: tuple[str, str, str] = ("li.cast", "strong", "")
    people_box: str = "div.people"  # where a list of terms stands in for the items
    suffix: str = ""
    cast_word: str = "cast"
    description: str = "div.description"
    description_mode: str = "paragraphs"  # or "whole", or "after": between a heading with these words and the next one
    description_words: str = "more about"
    read_more: str = "read more"
    hero: str = "div.hero"
    header: tuple[str, str, str, str, str] = ("figure.show-hero figcaption img", "ul.show-meta li.duration", "ul.show-meta a[href]", "li.location", "span.badge-category")
    hero_image: str = "mobile-img"
    venue_path: str = "/venue/"
    booking_period: str = "div#booking-period p"
    addresses: tuple[str, ...] = ("div#venue article p.address", "div#venue-sidebar p.address")
    book_button: str = "a.book-action"
    book_links: tuple[str, str] = ("div.calendar-modal a[href]", "/book/")
    calendar_box: str = "div#calendar"
    group_info: str = "div#groups p"
    features: tuple[str, str, str] = ("div.feature", "div.feature-header", "div.feature-text")
    feature_words: tuple[tuple[str, tuple[str, ...]], ...] = (("running_time", ("how long", "running time")), ("matinee_text", ("matinee",)), ("evening_text", ("evening",)))
    gallery: str = "div.gallery"
    closing: tuple[str, ...] = ("Booking until", "Closing date")
    schedule: str = "section#show-time"
    last_minute: str = "section#last-minute"
    last_minute_link: str = "a.last-minute__performance-link"
    deals: str = "article.deal"
    booking_path: str = "/book"
    calendar: str = "div[data-cal]"
    price: str = "a.book-now"
    badge: str = "span.badge"
    offer: str = "div.offer"
    tags: str = "a.tag"
    breadcrumb: str = "nav.breadcrumb"
    access: str = "div.access"
    access_words: tuple[str, ...] = ("wheelchair", "step-free", "hearing", "audio", "captioned", "toilet", "assistance")
    next_cards: str = "div.next-availability"
    months: str = "a.month"
    skip_crumbs: tuple[str, ...] = ("home", "shows")


def heading(root: Node, spec: Spec) -> str | None:
    h = root.one(spec.title)
    if h is None:
        return None
    first = next((x.strip() for x in h.texts() if x.strip()), None)
    return first if spec.title_mode == "first" and first else h.text() or None


def label_map(root: Node, spec: Spec) -> dict[str, str]:
    """Labels and the values beside them."""
    box, k, v = spec.info
    out: dict[str, str] = {}
    for b in root.all(box):
        out |= dict(zip((x.text() for x in b.all(k)), (x.text() for x in b.all(v))))
    return out


def people(root: Node, spec: Spec) -> list[dict]:
    """Role and name of each listed person; the name is what follows the role,
    separators aside. Without any item, the terms of the people's box and what they say."""
    place, role, name = spec.people
    out = []
    for item in root.all(place):
        r = item.one(role)
        who = item.one(name).text() if name and item.one(name) else _after(item.text(), r.text() if r else "")
        part = r.text().removesuffix(spec.suffix).strip() if r else None
        if who:
            out.append({"role": part or None, "name": who})
    if not out:
        for dl in root.within(f"{spec.people_box} dl"):
            for dt, dd in zip(dl.all("dt"), dl.all("dd")):
                if dt.text() or dd.text():
                    out.append({"role": dt.text().removesuffix(spec.suffix).strip() or None, "name": dd.text() or None})
    return out


def _after(text: str, head: str) -> str:
    return re.sub(r"^[\s:–—-]+", "", text[len(head) :] if text.lower().startswith(head.lower()) else text)


HEADINGS = ("h2", "h3", "h4")


def cast_list(root: Node, spec: Spec) -> list[dict]:
    """Role and name from the first list under a heading that speaks of the cast."""
    under = False
    for n in root.walk():
        if n.tag in HEADINGS:
            under = spec.cast_word in n.text().lower()
        elif under and n.tag == "ul":
            rows = [(item.text(), item.one("strong")) for item in n.all("li")]
            return [{"role": role, "name": _after(text, role) or None} for text, strong in rows if strong and (role := strong.text().rstrip(":").strip())]
    return []


def description(root: Node, spec: Spec) -> str | None:
    """The description's paragraphs (its text if there are none), its whole text,
    or the paragraphs after a heading up to the next (all of the page without such a heading)."""
    if spec.description_mode == "after":
        found, under = [], False
        for n in root.walk():
            if n.tag in HEADINGS:
                under = spec.description_words in n.text().lower()
            elif under and n.tag == "p":
                found.append(n.text())
        found = found or [p.text() for p in root.all("p")]
    else:
        box = root.one(spec.description)
        if box is None:
            return None
        found = [] if spec.description_mode == "whole" else [p.text() for p in box.all("p")]
        found = found or [box.text()]
    return "\n\n".join(p for p in found if p and p.lower() != spec.read_more) or None


def header(root: Node, spec: Spec) -> dict:
    """Thumbnail, duration, venue with its address, and badge of a page's header."""
    images, duration, links, place, badge = spec.header
    image = next((src for i in root.within(images) if spec.hero_image not in i.classes and (src := i.attrs.get("data-src") or i.attrs.get("src"))), None)
    venue = next((a for a in root.within(links) if spec.venue_path in a.attrs["href"]), None)
    return {"thumbnail": image, "duration": _text(root, duration), "venue": ((venue.one(place) or venue).text() or None) if venue else None, "venue_url": venue.attrs["href"] if venue else None, "badge": _text(root, badge)}


def _text(root: Node, path: str) -> str | None:
    found = root.within(path)
    return (found[0].text() or None) if found else None


def booking(root: Node, spec: Spec) -> dict:
    """Booking period, address (the first place that has one), booking address (the
    button's, else the first link of the calendar without a fragment), the calendar's number and start, and what groups are told."""
    button = root.one(spec.book_button)
    links, path = spec.book_links
    others = (a.attrs["href"] for a in root.within(links) if path in a.attrs["href"] and "#" not in a.attrs["href"])
    calendar = root.one(spec.calendar_box)
    told = [t for p in root.within(spec.group_info) if (t := p.text())]
    return {
        "booking_period": _text(root, spec.booking_period),
        "address": next((t for path in spec.addresses if (t := _text(root, path))), None),
        "book_url": button.attrs["href"] if button and button.attrs.get("href") else next(others, None),
        "calendar_id": ((calendar.attrs.get("data-id") or "").strip() or None) if calendar else None,
        "calendar_start": ((calendar.attrs.get("data-start") or "").strip() or None) if calendar else None,
        "group_info": "\n\n".join(told) or None,
    }


def features(root: Node, spec: Spec) -> dict:
    """Texts of feature blocks by words of their headers; of several the last."""
    place, head, body = spec.features
    out: dict[str, str | None] = dict.fromkeys(k for k, _ in spec.feature_words)
    for block in root.all(place):
        h, t = block.one(head), block.one(body)
        if h and t:
            name = next((k for k, words in spec.feature_words if any(w in h.text().lower() for w in words)), None)
            if name:
                out[name] = t.text()
    return out


def background(root: Node, spec: Spec) -> str | None:
    box = root.one(spec.hero)
    style = (box.attrs.get("style") or "") if box else ""
    m = re.search(r"url\(\s*(['\"])(.*?)\1\s*\)", style) or re.search(r"url\(\s*()([^'\")]+?)\s*\)", style)
    return m[2] if m else None


def gallery(root: Node, spec: Spec) -> list[str]:
    """Images of the galleries, the lazy address before the shown one, each once and in order."""
    return list(dict.fromkeys(src for g in root.all(spec.gallery) for i in g.all("img") if (src := i.attrs.get("data-src") or i.attrs.get("src"))))


def closing(labels: dict[str, str], spec: Spec) -> tuple[str | None, str | None]:
    """The first label of several that has a value, and the value."""
    return next(((k, labels[k]) for k in spec.closing if labels.get(k)), (None, None))


def weekly(root: Node, spec: Spec) -> list[dict]:
    """Rows of the weekly table; a dash is none."""
    box = root.one(spec.schedule)
    out = []
    for row in box.all("tr") if box else []:
        day, cells = row.one("th"), row.all("td")
        if day and len(cells) > 1:
            out.append({"day": day.text(), "matinee": filled(cells[0].text()), "evening": filled(cells[1].text())})
    return out


def weekly_from_lines(lines: list[str]) -> list[dict]:
    """Lines in pairs of a day and its times, these split at commas."""
    return [{"day": d, "times": [t.strip() for t in times.split(",") if t.strip() and t.strip() != "-"]} for d, times in zip(lines[::2], lines[1::2])]


def last_minute(root: Node, spec: Spec) -> list[dict]:
    """Links of the last-minute table by row and day cell: label, address, showtime number, whether it has deals."""
    box = root.one(spec.last_minute)
    out = []
    for row in box.all("tr") if box else []:
        for k, cell in enumerate(row.all("td")):
            for a in cell.all(spec.last_minute_link):
                out.append({"day": str(k), "time": a.text(), "book_url": a.attrs.get("href"), "showtime_id": a.attrs.get("data-id"), "has_deals": "true" if any("deal" in c for c in a.classes) else "false"})
    return out


def deals(root: Node, spec: Spec) -> list[dict]:
    """One row for each booking link of a deal card with the time and price near
    it, or one for the card if it has something to tell; a discount of 0 is none."""
    out = []
    for card in root.all(spec.deals):
        own = {"discount": number(card.attrs.get("data-discount")) or None, "min_price": number(card.attrs.get("data-min-price")), "max_price": number(card.attrs.get("data-max-price"))}
        time, price = _time_and_price(card.text())
        links = [a for a in card.all("a[href]") if spec.booking_path in a.attrs["href"]]
        for a in links:
            near = _near(a)
            t, p = _time_and_price(near)
            out.append({**own, "book_url": a.attrs["href"], "time": t or time, "price": p if p is not None else price})
        if not links and (any(v is not None for v in own.values()) or time or price):
            out.append({**own, "book_url": None, "time": time, "price": price})
    return out


def _near(a: Node, up: int = 4) -> str:
    """The text of the nearest node around a link that has some."""
    n = a.parent
    for _ in range(up):
        if n is None:
            break
        if len(t := n.text()) >= 10:
            return t
        n = n.parent
    return ""


def _time_and_price(text: str) -> tuple[str | None, float | None]:
    t, p = TIME.search(text), PRICE.search(text)
    return t[1] if t else None, number(p[1]) if p else None


def data_calendar(root: Node, spec: Spec) -> list[dict]:
    """Performances in the JSON of a calendar's attribute (its entities are decoded by the parser)."""
    box = root.one(spec.calendar)
    try:
        found = json.loads(box.attrs["data-cal"]) if box else {}
    except ValueError:
        return []
    return [{"date": p.get("date"), "time": p.get("time"), "min_price": p.get("min"), "max_price": p.get("max"), "available": bool(p.get("avail")), "book_url": p.get("bookUrl")} for p in found.get("performances") or []]


def button_price(root: Node, spec: Spec) -> tuple[float | None, bool]:
    """The price on the booking button without its badge's text, and whether there is a badge."""
    box = root.one(spec.price)
    if box is None:
        return None, False
    badge = box.one(spec.badge)
    text = box.text().replace(badge.text(), " ", 1) if badge else box.text()
    m = PRICE.search(text)
    return (number(m[1].replace(",", ".")) if m else None), badge is not None


def card_list(root: Node, spec: Spec) -> list[dict]:
    """Listing cards in order, the first of each key: key, title, address, genres from classes."""
    out: dict[str, dict] = {}
    for pos, n in enumerate(root.all(spec.card)):
        key = n.attrs.get(spec.card_key)
        if key and key not in out:
            a = n.one("a[href]")
            title = n.one("h2") or n.one("h3") or a
            out[key] = {"pos": pos, "key": key, "title": title.text() if title else None, "url": a.attrs["href"] if a else None, "genres": [c.removeprefix("genre-") for c in n.classes if c.startswith("genre-")]}
    return list(out.values())


def tag_links(root: Node, spec: Spec) -> list[dict]:
    return [{"name": a.text(), "url": a.attrs.get("href"), "slug": (a.attrs.get("href") or "").rstrip("/").rsplit("/", 1)[-1] or None} for a in root.all(spec.tags)]


def crumb(root: Node, spec: Spec) -> str | None:
    """The last link of the breadcrumb that isn't one of the plain ones."""
    box = root.one(spec.breadcrumb)
    found = [a.text() for a in box.all("a") if a.text().lower() not in spec.skip_crumbs] if box else []
    return found[-1] if found else None


def access_texts(root: Node, spec: Spec) -> list[str]:
    """Blocks directly inside the access box that speak of access."""
    box = root.one(spec.access)
    blocks = [x.text() for x in box.children if isinstance(x, Node) and x.tag == "div"] if box else []
    return [t for t in blocks if any(w in t.lower() for w in spec.access_words)]


def offer_card(root: Node, spec: Spec) -> tuple[str | None, str | None]:
    box = root.one(spec.offer)
    if box is None:
        return None, None
    head = box.one("h3") or box.one("strong")
    title = head.text() if head else None
    return title, filled(box.text().removeprefix(title or "").strip())


def next_rows(root: Node, spec: Spec) -> list[dict]:
    """One row for each performance link of the next-availability cards."""
    return [{"day": (c.one("h4") or c).text(), "time": a.text(), "url": a.attrs["href"]} for c in root.all(spec.next_cards) for a in c.all("a[href]")]


def month_rows(root: Node, spec: Spec) -> list[dict]:
    out = []
    for a in root.all(spec.months):
        m = re.match(r"([A-Za-z]+)\s+(\d{4})", a.text())
        out.append({"label": a.text(), "month": m[1] if m else None, "year": int(m[2]) if m else None, "url": a.attrs.get("href")})
    return out


WIDGETS = (
    "title string, labels map<string, string>, people array<struct<role: string, name: string>>, description string, hero string, gallery array<string>, closing_label string, closing string, "
    "weekly array<struct<day: string, matinee: string, evening: string>>, last_minute array<struct<day: string, time: string, book_url: string, showtime_id: string, has_deals: string>>, "
    "deals array<struct<discount: double, min_price: double, max_price: double, book_url: string, time: string, price: double>>, calendar array<struct<date: string, time: string, min_price: double, max_price: double, available: boolean, book_url: string>>, "
    "price double, on_offer boolean, offer_title string, offer string, cards array<struct<pos: int, key: string, title: string, url: string, genres: array<string>>>, tags array<struct<name: string, url: string, slug: string>>, category string, access array<string>, "
    "next_rows array<struct<day: string, time: string, url: string>>, months array<struct<label: string, month: string, year: int, url: string>>, "
    "cast array<struct<role: string, name: string>>, thumbnail string, duration string, venue string, venue_url string, badge string, booking_period string, address string, book_url string, calendar_id string, calendar_start string, group_info string, "
    "running_time string, matinee_text string, evening_text string"
)


def _one(name: str, make: Callable) -> tuple[tuple[str, ...], Callable[[Node, Spec], dict]]:
    return (name,), lambda root, spec: {name: make(root, spec)}


#: What makes which columns; functions that give several columns are called once for all of them.
MAKERS: tuple[tuple[tuple[str, ...], Callable[[Node, Spec], dict]], ...] = (
    _one("title", heading), _one("labels", label_map), _one("people", people), _one("description", description), _one("hero", background), _one("gallery", gallery),
    (("closing_label", "closing"), lambda root, spec: dict(zip(("closing_label", "closing"), closing(label_map(root, spec), spec)))),
    _one("weekly", weekly), _one("last_minute", last_minute), _one("deals", deals), _one("calendar", data_calendar),
    (("price", "on_offer"), lambda root, spec: dict(zip(("price", "on_offer"), button_price(root, spec)))),
    (("offer_title", "offer"), lambda root, spec: dict(zip(("offer_title", "offer"), offer_card(root, spec)))),
    _one("cards", card_list), _one("tags", tag_links), _one("category", crumb), _one("access", access_texts), _one("next_rows", next_rows), _one("months", month_rows), _one("cast", cast_list),
    (("thumbnail", "duration", "venue", "venue_url", "badge"), header),
    (("booking_period", "address", "book_url", "calendar_id", "calendar_start", "group_info"), booking),
    (("running_time", "matinee_text", "evening_text"), features),
)


def page_widgets(html: str | None, spec: Spec = Spec(), only: Collection[str] = ()) -> dict:
    """All widgets of a page, or those asked for."""
    root, out = tree(html), {}
    for names, make in MAKERS:
        if not only or any(n in only for n in names):
            out.update(make(root, spec))
    root.page.unlink()
    return {k: v for k, v in out.items() if not only or k in only}


def widgets(pages: DataFrame, key: str, spec: Spec = Spec(), html: str = "html", only: Collection[str] = ()) -> DataFrame:
    """The widgets of each page under its key (those asked for, or all); what a page lacks is null or empty."""
    fields = [f for f in T._parse_datatype_string(WIDGETS).fields if not only or f.name in only]
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), *fields])
    kinds = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_widgets(x, spec, only) for x in batch.column(1).to_pylist()]
            columns = [pa.array([x[f.name] for x in found], kinds.field(f.name).type) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds.field(0).type), *columns], schema=kinds)

    return pages.select(key, html).mapInArrow(rows, schema)


# --- what needs no parser


def any_case(m: Column, name: str) -> Column:
    """A map's value by key in any case; empty values are none."""
    low = F.transform_values(F.transform_keys(m, lambda k, _: F.lower(k)), lambda _, v: F.nullif(v, F.lit("")))
    return F.try_element_at(low, F.lit(name.lower()))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts])


def canonical_url(canonical: Column, own: Column) -> Column:
    """The canonical address wherever there is one."""
    return F.coalesce(F.nullif(canonical, F.lit("")), own)


def seat_request(perf_id: Column, show_id: Column, venue_url: Column, date: Column, time: Column, tickets: int = 2) -> Column:
    """The body of a seat-plan request; null if any part is missing."""
    venue = F.nullif(F.regexp_extract(venue_url, r"/(\d+)(?:/|$|[?#])", 1), F.lit(""))
    day = F.date_format(F.try_to_date(date, "yyyy-MM-dd"), "dd/MM/yyyy")
    ok = F.nullif(perf_id.cast("string"), F.lit("")).isNotNull() & show_id.isNotNull() & venue.isNotNull() & day.isNotNull() & time.contains(":")
    fields = {"performanceId": perf_id.cast("string"), "showId": show_id.cast("string"), "VenueId": venue, "tickets": F.lit(str(tickets)), "PDate": day, "Time": F.replace(time, F.lit(":"), F.lit("-")), "PerformancesFor": F.lit("SeatPlan")}
    return F.when(ok, F.struct(*[v.alias(k) for k, v in fields.items()]))


def id_by_url(rows: Column) -> Column:
    """A map from a booking address to the showtime number beside it; rows without one are passed over, of several the first counts."""
    known = F.filter(rows, lambda r: r["book_url"].isNotNull() & r["showtime_id"].isNotNull())
    first = F.filter(known, lambda r, i: ~F.exists(F.slice(known, F.lit(1), i), lambda o: o["book_url"] == r["book_url"]))
    return F.map_from_entries(F.transform(first, lambda r: F.struct(r["book_url"], r["showtime_id"])))


def fragment_html(status: Column, content_type: Column, body: Column) -> Column:
    """The page fragment in an answer's ``html``; null unless the answer is good, JSON, an object, and has such a text."""
    ok = (status < 400) & F.lower(content_type).contains("json") & F.ltrim(body).startswith("{") & F.regexp_like(body, F.lit(r'"html"\s*:\s*"'))
    return F.when(ok, F.nullif(F.trim(F.get_json_object(body, "$.html")), F.lit("")))


def first_venue(venues: Column) -> Column:
    """Of the performances' venues, the first that a name can be cut from."""
    from ..functions.text import venue_first_part

    return F.try_element_at(F.filter(F.transform(venues, venue_first_part), lambda v: v.isNotNull()), F.lit(1))


def when_empty(rows: Column, other: Column) -> Column:
    """Another array where the first one is null or empty."""
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, rows).otherwise(other)


def crumb_category(items: Column, part: str = "/category/") -> Column:
    """Of breadcrumb items (position, name, url), by position (missing ones last), the first under a category address."""
    ordered = F.array_sort(F.transform(items, lambda x: F.struct(F.coalesce(x["position"], F.lit(999)).alias("position"), x["name"].alias("name"), x["url"].alias("url"))))
    return F.try_element_at(F.filter(ordered, lambda x: x["url"].contains(part)), F.lit(1))["name"]


def graph_items(text: Column, schema: str) -> Column:
    """Items of a linked-data text: those of its ``@graph``, or itself."""
    graph = F.from_json(text, f"struct<`@graph`: array<{schema}>>")["@graph"]
    return F.coalesce(graph, F.array(F.from_json(text, schema)))
