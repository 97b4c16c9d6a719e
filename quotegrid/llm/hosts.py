"""URL filters: path rules first, then an empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix. Each level's spread around its parents gives the strength of a beta
prior by the method of moments; a suffix's share of bad pages is shrunk to the
share of all pages, a domain's to its suffix, and a host gets the beta posterior
with its domain's share as prior mean. A host is blocked if the lower bound of
its posterior (mean less z standard deviations) exceeds a threshold, so a host
with few labels is judged by its domain and one without any by the nearest level
that has some.

Outcomes are an input (host, labelled pages, bad ones). The tables have no page
labels, so the query makes weak ones from what stands in the pages alone
(``page_outcomes``): a page is bad if its text is junk (a symbol for each ten
words or more), has hardly any words, or says the same few words again. Nothing
in a host's name counts, so it is for the posterior to find out whether a host
has more bad pages than chance gives it.

DataFrame operations only. The driver holds one row of sums for each level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, spread_join, written

# Rules as (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
# Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
# Symbols of junk text.
SYMBOLS = "[#*$%|]"
#: Of a clean page: symbols for each word at most, words at least, and distinct words for each word at least.
MOST_SYMBOLS, LEAST_WORDS, LEAST_DISTINCT = 0.1, 50, 0.3
Z, THRESHOLD = 1.645, 0.5
LEAST_STRENGTH, MOST_STRENGTH = 0.5, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path; both empty for null and where ``://`` is missing."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path on end; the first of equally long ones) and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):  # the last condition that is put around wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain (one label more than the suffix, or the host itself) and the suffix."""
    two = F.substring_index(host, ".", -2)
    longer = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(longer, F.substring_index(host, ".", -3)).otherwise(two), F.when(longer, two).otherwise(F.substring_index(host, ".", -1))


def _strength(sums, share: float) -> float:
    """How many pages a prior is worth: from the share's spread between groups, by moments."""
    n, squares, k, own, bad = (float(x or 0) for x in sums)
    spread = own - 2 * share * bad + share * share * n
    within = share * (1 - share)
    room = within * (n - squares / n - (k - 1)) if n else 0.0
    between = (spread - within * (k - 1)) / room if room > 0 else 1.0
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / between - 1)) if between > 0 else MOST_STRENGTH


def _sums(level: DataFrame, name: str) -> DataFrame:
    return level.where("n > 0").agg(F.lit(name).alias("level"), F.sum("n"), F.sum(F.col("n") * F.col("n") / 1.0), F.count("*"), F.sum(F.col("bad") * F.col("bad") / F.col("n")), F.sum("bad"))


def reputation(outcomes: DataFrame, hosts: DataFrame | None = None, z: float = Z) -> DataFrame:
    """For outcomes (host, n, bad), and for further ``hosts`` (host): host, mean,
    bound. Several rows of a host add up. A host without labelled pages has the
    prior of its domain, of its suffix if the domain has none either, and of all
    pages if the suffix has none."""
    counts = outcomes.select("host", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))
    if hosts is not None:
        counts = counts.unionByName(hosts.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")))
    domain, suffix = domain_and_suffix(F.col("host"))
    total = [F.sum(x).alias(x) for x in ("n", "bad")]
    own = written(counts.groupBy("host").agg(*total).withColumns({"domain": domain, "suffix": suffix}))
    domains = own.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    sums = {r[0]: r[1:] for r in _sums(own, "host").union(_sums(domains, "domain")).union(_sums(suffixes, "suffix")).collect()}
    share = float(sums["suffix"][4] or 0) / float(sums["suffix"][0]) if sums["suffix"][0] else 0.0
    s, d, h = (_strength(sums[x], share) for x in ("suffix", "domain", "host"))
    suffixes = suffixes.select("suffix", ((F.col("bad") + s * share) / (F.col("n") + s)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + d * F.col("suffix_mean")) / (F.col("n") + d)).alias("domain_mean"))
    a, b = F.col("bad") + h * F.col("domain_mean"), F.col("n") - F.col("bad") + h * (1 - F.col("domain_mean"))
    posts = own.join(domains, "domain").select("host", a.alias("a"), b.alias("b"))
    mean = F.expr("a / (a + b)")
    return posts.select("host", mean.alias("mean"), (mean - z * F.sqrt(F.expr("a * b / ((a + b) * (a + b) * (a + b + 1))"))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """A row for each row of ``pages``: page_id, host, path, rule, verdict, bound.

    A url that is null or has no ``://`` has an empty host and path and no rule,
    and is allowed. A host without labelled pages is judged by its domain or
    suffix; without any labels at all every bound is below the threshold. Of
    equally long rules the first counts; a bound at the threshold allows. A very
    long url is read whole. Repeated rows get equal rows; an empty table gives an
    empty result; other columns aren't read.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = reputation(outcomes, parts.select("host").where("host <> ''").distinct(), z)
    joined = spread_join(parts.withColumns({"rule": rule, "said": verdict}), known, ["host"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("bound") > threshold, "block").otherwise("allow")).alias("verdict"), "bound")


def page_outcomes(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", most_symbols: float = MOST_SYMBOLS, least_words: int = LEAST_WORDS, least_distinct: float = LEAST_DISTINCT) -> DataFrame:
    """Outcomes (host, n, bad) of the pages of each host, from their text, tags
    aside: a page with too many symbols, too few words or too few distinct ones is
    bad. A page without words (null or empty html among them) has no outcome, and
    one without a host isn't counted; a measure at its limit is clean; repeated
    rows are pages of their own; a very long page counts whole; an empty table
    gives no row."""
    host, _ = host_and_path(F.col(url_col))
    text = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), "<[^>]*>", " ")
    rows = pages.select(host.alias("host"), F.regexp_count(text, F.lit(SYMBOLS)).alias("symbols"), F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})")).alias("w")).where("host <> '' and size(w) > 0")
    words = F.size("w")
    bad = (F.col("symbols") > most_symbols * words) | (words < least_words) | (F.size(F.array_distinct("w")) < least_distinct * words)
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    tail = lambda k: f"array_to_string(string_split(host, '.')[-{k}:], '.')"
    strength = lambda level: f"""SELECT CASE WHEN sum(n) IS NULL THEN 1000.0 ELSE (
        SELECT CASE WHEN b <= 0 THEN {MOST_STRENGTH} ELSE least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, 1 / b - 1)) END FROM (
          SELECT CASE WHEN room > 0 THEN (spread - within_ * (k - 1)) / room ELSE 1.0 END AS b FROM (
            SELECT k, spread, within_, within_ * (m - squares / m - (k - 1)) AS room FROM (
              SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS m, sum(n * n)::DOUBLE AS squares, sum(n * pow(bad::DOUBLE / n - g, 2)) AS spread, any_value(g * (1 - g)) AS within_
              FROM {level}, share WHERE n > 0)))) END::DOUBLE AS c FROM {level}"""  # noqa: E731
    return f"""
WITH cut AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS text, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
named AS (SELECT page_id, len(regexp_extract_all(text, '{SYMBOLS}')) AS symbols, regexp_extract_all(text, '{WORD_PATTERN}') AS w, translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, CASE {' '.join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in longest)} END AS rule,
  CASE {' '.join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)} END AS said FROM named),
hosts AS (SELECT host, count(*) FILTER (len(w) > 0)::DOUBLE AS n, count(*) FILTER (len(w) > 0 AND (symbols > {MOST_SYMBOLS}::DOUBLE * len(w) OR len(w) < {LEAST_WORDS} OR len(list_distinct(w)) < {LEAST_DISTINCT}::DOUBLE * len(w)))::DOUBLE AS bad,
  CASE WHEN {tail(2)} IN ({two}) THEN {tail(3)} ELSE {tail(2)} END AS domain, CASE WHEN {tail(2)} IN ({two}) THEN {tail(2)} ELSE {tail(1)} END AS suffix
  FROM named WHERE host <> '' GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
share AS (SELECT sum(bad) / sum(n) AS g FROM suffixes),
cs AS ({strength('suffixes')}), cd AS ({strength('domains')}), ch AS ({strength('hosts')}),
sm AS (SELECT suffix, (bad + cs.c * g) / (n + cs.c) AS mean FROM suffixes, share, cs),
dm AS (SELECT domain, (bad + cd.c * sm.mean) / (n + cd.c) AS mean FROM domains JOIN sm USING (suffix), cd),
post AS (SELECT host, bad + ch.c * dm.mean AS a, n - bad + ch.c * (1 - dm.mean) AS b FROM hosts JOIN dm USING (domain), ch)
SELECT page_id, ruled.host AS host, path, rule,
  coalesce(said, CASE WHEN a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN post ON ruled.host = post.host
"""


SQL = _sql()
