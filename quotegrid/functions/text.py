"""Text normalisation of titles and venues, and small text helpers.

What needs Unicode normal forms or a callback for each match runs as an Arrow
function, once for each distinct value of a batch. All else are built-in expressions.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import ARTICLES, SUBTITLES, TITLE_PREFIXES, VENUE_ALIASES

_BROKEN = re.compile("[\xc2\xc3\xe2][\x80-\xbf]+")
_TYPOGRAPHY = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "})
_PUNCTUATION, _SPACE = re.compile(r"[^\w\s]"), re.compile(r"\s+")


def mended(s: str) -> str:
    """Text whose UTF-8 bytes were read as Latin-1, run by run; runs that don't decode stay."""

    def decoded(m: re.Match[str]) -> str:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]

    return _BROKEN.sub(decoded, s).replace("\xc2 ", " ")


def folded(s: str) -> str:
    """Mended text in composed form with plain quotes, dashes and spaces."""
    return unicodedata.normalize("NFC", mended(s)).translate(_TYPOGRAPHY)


def unaccented(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _bare(s: str) -> str:
    return _SPACE.sub(" ", _PUNCTUATION.sub("", s)).strip()


def _without_end(s: str, ends: tuple[str, ...]) -> str:
    return next((s.removesuffix(e) for e in ends if s.endswith(e)), s)


def venue_form(raw: str) -> str:
    """The form of a venue's name under which aliases are looked up."""
    s = unaccented(folded(raw).lower().strip()).removeprefix("the ")
    return _bare(_without_end(_without_end(s, (" theatre", " theater")), (", london", " london")))


def alias_forms(aliases: Mapping[str, tuple[str, ...]] = VENUE_ALIASES) -> dict[str, str]:
    """The canonical name for each known form."""
    return {venue_form(name): canonical for canonical, others in aliases.items() for name in (canonical, *others)}


_KNOWN = alias_forms()


def venue_key(raw: str | None, known: Mapping[str, str] = _KNOWN) -> tuple[str | None, str | None]:
    """The key that all names of a venue share, and the name to show; nulls if nothing is left of the name."""
    form = venue_form(raw) if raw else ""
    if not form:
        return None, None
    canonical = known.get(form)
    return (venue_form(canonical), canonical) if canonical else (form, folded(raw).strip())


# A venue behind a dash at a title's end, and a bracket there.
VENUE_BEHIND = re.compile(r"^(.+?)\s*-\s*(?:the\s+)?([^-]+)\s*$")
BRACKET_AT_END = re.compile(r"\s*[(\[][^)\]]+[)\]]\s*$")


def _cut_venue(s: str, is_venue: Callable[[str], bool]) -> str:
    found = VENUE_BEHIND.search(s)
    return found[1] if found and is_venue(found[2].strip()) else s


def _cut_prefixes(s: str, _: Callable[[str], bool]) -> str:
    for p in TITLE_PREFIXES:
        s = s.removeprefix(p + " ").strip()
    return s


#: What a title's key leaves out, in this order.
TITLE_RULES: tuple[tuple[str, Callable[[str, Callable[[str], bool]], str]], ...] = (
    ("its own venue", _cut_venue),
    ("a bracket at the end", lambda s, _: BRACKET_AT_END.sub("", s, count=1)),
    ("a known subtitle", lambda s, _: _without_end(s, SUBTITLES)),
    ("franchises before it", _cut_prefixes),
    ("an article", lambda s, _: next((s.removeprefix(a) for a in ARTICLES if s.startswith(a)), s)),
    ("marks at the end", lambda s, _: s.rstrip("!?.,")),
)


def title_key(raw: str | None, venue_norm: str | None = None, known: Mapping[str, str] = _KNOWN) -> str:
    """A title without case, accents, punctuation, and what TITLE_RULES name."""
    if not raw:
        return ""
    is_venue = lambda name: bool(venue_norm) and venue_key(name, known)[0] == venue_norm
    s = unaccented(folded(raw).lower().strip())
    for _, rule in TITLE_RULES:
        s = rule(s, is_venue).strip()
    return _bare(s)


def _each_once(values: Iterable, make: Callable) -> list:
    """``make`` of all values, computed once for each distinct one."""
    values = list(values)
    known = {v: make(v) for v in set(values)}
    return [known[v] for v in values]


def _text(v: object) -> str | None:
    return v if isinstance(v, str) else None


@F.pandas_udf(T.StringType())
def mend(s: pd.Series) -> pd.Series:
    return pd.Series(_each_once(map(_text, s), lambda x: None if x is None else mended(x)), dtype=object)


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    return s.map(folded, na_action="ignore")


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(unaccented, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_title(title: pd.Series, venue_norm: pd.Series) -> pd.Series:
    """The title key; empty for null."""
    return pd.Series(_each_once(zip(map(_text, title), map(_text, venue_norm)), lambda p: title_key(*p)), dtype=object)


@F.pandas_udf(T.StructType().add("venue_norm", "string").add("venue_canonical", "string"))
def normalize_venue(venue: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_each_once(map(_text, venue), venue_key), columns=["venue_norm", "venue_canonical"])


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Entities decoded twice over where they were encoded twice, stripped; empty as null."""
    return s.map(lambda x: html.unescape(html.unescape(x)).strip() or None, na_action="ignore")


def slug(name: Column) -> Column:
    """Lower case ASCII letters and digits with hyphens between; apostrophes vanish."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "['’]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def show_id(title: Column, venue: Column, most: int = 120) -> Column:
    """``title__venue`` in lower case with hyphens for all but word characters, cut to a length."""
    joined = F.lower(F.concat(title, F.lit("__"), venue))
    return F.substring(F.regexp_replace(F.regexp_replace(joined, r"(?U)[^\w]+", "-"), "^-+|-+$", ""), 1, most)


def shouting(s: Column) -> Column:
    """Whether more than 0.6 of the letters are capitals."""
    letters, capitals = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    return F.coalesce((letters > 0) & (capitals > letters * 0.6), F.lit(False))


def input_hash(*columns: Column) -> Column:
    """Of values (null as ``none``, numbers with six decimals) joined by ``|``, the first 16 hex digits of SHA-1."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(c, F.lit("none")) for c in columns])), 1, 16)


def number_text(x: Column) -> Column:
    return F.format_string("%.6f", x.cast("double"))


def perf_key(date: Column, time: Column, url: Column) -> Column:
    """``date|time|url``; null if any is missing."""
    return F.when(date.isNotNull() & time.isNotNull() & url.isNotNull(), F.concat_ws("|", date.cast("string"), time, url))


def paragraphs(markdown: Column) -> Column:
    """The paragraphs of a simple markdown text, without its marks."""
    s = markdown
    for pattern, by in ((r"\r\n?", "\n"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1")):
        s = F.regexp_replace(s, pattern, by)
    return F.filter(F.transform(F.split(s, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def without_suffix(s: Column, suffix: str) -> Column:
    return F.when(F.endswith(s, F.lit(suffix)), F.rtrim(F.substring(s, F.lit(1), F.length(s) - len(suffix)))).otherwise(s)


def venue_first_part(s: Column) -> Column:
    """The first line, up to the first comma, trimmed; empty as null."""
    return F.nullif(F.trim(F.split_part(F.split_part(s, F.lit("\n"), F.lit(1)), F.lit(","), F.lit(1))), F.lit(""))


def notice(lines: Column, prefix: str) -> Column:
    """Of lines, the last that begins with a prefix in either case; null without one."""
    found = F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(F.lower(x), F.lit(prefix)))
    return F.try_element_at(found, F.lit(-1))


def prefix_count(failures: Column) -> Column:
    """What stands before the first colon of a failure."""
    return F.trim(F.split_part(failures, F.lit(":"), F.lit(1)))


# sellers' display names.
SELLER_LABELS = {"seatplan": "SeatPlan", "todaytix": "TodayTix", "lovetheatre": "LOVEtheatre", "olt": "Official London Theatre", "ttd": "Theatre Tickets Direct"}


def seller_label(source: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in SELLER_LABELS.items() for x in kv])
    return F.coalesce(labels[source], source)
