"""Secret scans over an incremental ledger of blobs.

A blob is a text under its SHA-256. However many paths and versions hold it, it
is scanned once for each version of the rules: blobs whose (blob, rule version)
pair is in the ledger are left out, the rest are scanned and added, and findings
go back to all paths that hold the blob.

DataFrame operations only. Places of matches come from the pieces between them:
a match starts after all pieces and matches before it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, spread_join, written


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
# Kind, pattern, group whose length counts, least length. The first three are the base kinds.
RULES = (
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("github", r"gh[opsru]_[A-Za-z0-9]{36,}", 0, 40),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 26),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
)
BASE = 3


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Matches whose places are summed up together: a text's matches cost their number times this, not its square.
RUN = 64


def _spans(k: int, rule: tuple[str, str, int, int]) -> Column:
    """An array of (start, kind's number, end) of a rule's matches that are long
    enough; empty without any. Places are summed up inside runs of matches, then over the runs."""
    _, pattern, group, least = rule
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    matches, counted = f"regexp_extract_all(text, '{quoted}', 0)", "x.`1`"
    if group:
        matches, counted = f"{matches}, regexp_extract_all(text, '{quoted}', {group})", "x.`2`"
    none = "cast(array() as array<struct<start: int, kind: int, stop: int>>)"
    sizes = f"filter(transform(arrays_zip(split(text, '{quoted}', -1), {matches}), x -> named_struct('gap', length(x.`0`), 'n', length(x.`1`), 'm', length({counted}))), x -> x.n is not null)"
    one = f"named_struct('start', acc.at + x.gap, 'kind', {k}, 'stop', acc.at + x.gap + x.n)"
    run = f"aggregate(r, named_struct('at', 0, 'out', {none}), (acc, x) -> named_struct('at', acc.at + x.gap + x.n, 'out', if(x.m >= {least}, array_append(acc.out, {one}), acc.out)))"
    runs = f"transform(sequence(0, size(s) - 1, {RUN}), i -> {_let('r', f'slice(s, i + 1, {RUN})', run)})"
    before = "aggregate(rs, named_struct('at', 0, 'all', cast(array() as array<int>)), (acc, r) -> named_struct('at', acc.at + r.at, 'all', array_append(acc.all, acc.at)), acc -> acc.all)"
    moved = f"flatten(zip_with(rs, {before}, (r, o) -> transform(r.out, y -> named_struct('start', y.start + o, 'kind', y.kind, 'stop', y.stop + o))))"
    return F.expr(f"if(not regexp_like(text, '{quoted}'), {none}, {_let('s', sizes, _let('rs', runs, moved))})")


def _named(spans: str, names: list[str]) -> str:
    kinds = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({kinds}, x.kind + 1), ':', x.start, ':', x.stop)), ',')"


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows (blob, rule_version, found) for blobs (blob, text); found: the
    spans (start, kind's number, end) in the order of start and kind, in code points."""
    spans = F.array_sort(F.concat(*[_spans(k, r) for k, r in enumerate(rules)]))
    return blobs.select("blob", F.lit(rule_version(rules)).alias("rule_version"), spans.alias("found"))


def _blob(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def update(docs: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text", rules=RULES) -> DataFrame:
    """The ledger's rows for blobs of ``docs`` that it hasn't under these rules.
    Copies of a text meet as one row for each task at most. Against a ledger,
    hashes alone are compared; texts move only if some blob is new."""
    docs = docs.select(_blob(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version(rules)).select("blob")
        unseen = written(docs.select("blob").distinct().join(known, "blob", "left_anti"))
        docs = spread_join(docs, unseen, ["blob"]) if unseen.take(1) else docs.where(F.lit(False))
    return scan(docs.groupBy("blob").agg(F.first("text").alias("text")), rules)


def _over_paths(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    paths = written(docs.select(F.col(id_col).alias("doc_id"), _blob(text_col).alias("blob")))
    held = known.where(F.size("found") > 0).select("blob", "found")
    none = F.expr("cast(array() as array<struct<start: int, kind: int, stop: int>>)")
    return spread_join(paths, held, ["blob"], "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def findings(docs: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs``, and the new ledger rows (written).

    Rows: doc_id, blob, found (see ``scan``). A null text is scanned as an empty
    one, a very long one whole. Rows with one id, repeated rows among them, are
    paths of their own; of overlapping spans of several kinds all are given, in
    the order of start and kind. An empty table gives no rows; other columns
    aren't read.

    A first run has no ledger and scans every blob once, however many paths hold
    it; with the ledger of the runs before, only blobs new under these rules.
    """
    new = written(update(docs, ledger, text_col=text_col, rules=rules))
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version") == rule_version(rules)).select(*new.columns))
    return _over_paths(docs, known, id_col, text_col), new


LEDGER = "blob binary, rule_version string, found array<struct<start: int, kind: int, stop: int>>"


def record(docs: DataFrame, path: str, *, text_col: str = "text", rules=RULES) -> int:
    """A run over ``docs`` onto the ledger stored at ``path`` (a new one, if nothing
    stands there): blobs that it lacks under these rules are scanned and added as
    files of their own. How many they were. One run writes at a time; of a run
    that broke off a part may stand there, and the next one scans the rest.

    A null text is an empty one; copies and repeated rows are one blob; an empty
    table adds nothing; other columns aren't read."""
    spark = docs.sparkSession
    before = stored(spark, path)
    new = written(update(docs, before, text_col=text_col, rules=rules))
    n = new.count()
    if n or before is None:
        new.write.mode("append").partitionBy("rule_version").parquet(path)
    return n


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``; None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def recorded(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``findings`` from the ledger at ``path``, which has to hold the
    blobs of ``docs``: none is scanned, so what isn't there counts as clean."""
    ledger = stored(docs.sparkSession, path)
    known = ledger.where(F.col("rule_version") == rule_version(rules))
    return _over_paths(docs, known, id_col, text_col)


def scan_twice(docs: DataFrame) -> DataFrame:
    """Findings of ``docs`` by a stored ledger: a first run fills it, and a second
    run over the same table meets nothing unseen and reads all findings from it."""
    path = shared_dir(docs.sparkSession)
    record(docs, path)
    again = record(docs, path)
    if again:
        raise RuntimeError(f"{again} blobs were scanned twice")
    return recorded(docs, path)


def digest(found: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    names = [r[0] for r in rules]
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = {k})) as long)").alias(f"n_{names[k]}") for k in range(BASE)]
    base = F.expr(_named(f"filter(found, x -> x.kind < {BASE})", names))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.expr(_named("found", names)).alias("spans"))


def _sql() -> str:
    """Matches and their places by the pieces between them, as lists."""
    steps, kinds = [], []
    for k, (name, pattern, group, least) in enumerate(RULES):
        q = pattern.replace("'", "''")
        steps.append(f"""
k{k} AS (SELECT doc_id, rid, unnest(range(1, len(m) + 1)) AS i, m, p, g FROM (SELECT doc_id, rid, regexp_extract_all(t, '{q}', 0) AS m, string_split_regex(t, '{q}') AS p, regexp_extract_all(t, '{q}', {group}) AS g FROM d WHERE regexp_matches(t, '{q}'))),
s{k} AS (SELECT doc_id, rid, {k} AS kind, '{name}' AS name, len(m[i]) AS w,
  list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, length(m[i]) AS n FROM k{k} WHERE length(g[i]) >= {least})""")
        kinds.append(f"SELECT rid, kind, name, start, start + n AS stop FROM s{k}")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents), {','.join(steps)},
f AS ({' UNION ALL '.join(kinds)}),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {BASE}) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


SQL = _sql()
