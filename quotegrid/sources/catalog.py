"""Reading and writing catalogues, rules, histories, caches and exports."""

from __future__ import annotations

import datetime
import io
import json
import logging
import zipfile
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import SOURCE_PRIORITY
from ..operators.history import SCHEMA as HISTORY_SCHEMA
from .documents import read_members

c = F.col
log = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by Spark's own file system."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


# For each source, the names of a show's fields in its files; a dot leads into a struct.
SHOW_FIELDS = {
    "olt": {"source_id": "id", "title": "title", "venue": "venue.name", "url": "url", "description": "description", "performances": "performances"},
    "todaytix": {"source_id": "id", "title": "title", "venue": "venue", "url": "url", "description": "description", "performances": "showtimes"},
    "lovetheatre": {"source_id": "post_id", "title": "title", "venue": "venue_name", "url": "url", "description": "description", "performances": "performances"},
    "seatplan": {"source_id": "slug", "title": "title", "venue": "venue_name", "url": "url", "description": "description", "performances": "performances"},
    "ttd": {"source_id": "id", "title": "title", "venue": "venue_name", "url": "url", "description": "description", "performances": "performances"},
}


#: A record's columns and the fields that they come from.
RECORD_FIELDS = (("source_id", "source_id"), ("title", "title_raw"), ("venue", "venue_raw"), ("url", "url"), ("description", "description"))
#: Record numbers of one source; the next source's begin after them.
SOURCE_ROWS = 1_000_000_000


def load_sources(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The payload of each known source from ``<source>.json`` in a folder or a
    zip, in the order of preference. Other files are passed over, missing ones left out; a path that isn't there is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if path.lower().endswith(".zip"):
        return _from_zip(spark, path)
    return {s: spark.read.json(f"{path}/{s}.json", multiLine=True) for s in SOURCE_PRIORITY if exists(spark, f"{path}/{s}.json")}


def _from_zip(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A zip can't be split: one task opens it and gives its members as rows."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.rsplit("/", 1)[-1] in {f"{s}.json" for s in SOURCE_PRIORITY}]
                    yield pd.DataFrame([(n.rsplit("/", 1)[-1][:-5], z.read(n).decode()) for n in names], columns=["source", "body"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "source string, body string")
    out = {}
    for s in SOURCE_PRIORITY:
        own = rows.where(c("source") == s).select("body")
        first = own.first()
        if first:
            schema = spark.range(1).select(F.schema_of_json(F.lit(first[0]))).first()[0]
            out[s] = own.select(F.from_json("body", schema).alias("x")).select("x.*")
    return out


def extract_records(sources: dict[str, DataFrame], fields=SHOW_FIELDS) -> DataFrame:
    """Show records of all sources: rec_id (by source order and place), source,
    source_id as text, title_raw, venue_raw, url, description. A field that a payload lacks is null."""
    out = None
    for rank, (source, payload) in enumerate(sources.items()):
        shows = payload.select(F.posexplode("shows").alias("pos", "s"))
        have = shows.schema["s"].dataType
        pick = lambda name: _field(c("s"), have, fields[source][name])  # noqa: B023, E731
        own = shows.select((F.lit(rank) * 1_000_000_000 + c("pos")).cast("long").alias("rec_id"), F.lit(source).alias("source"), pick("source_id").cast("string").alias("source_id"), pick("title").cast("string").alias("title_raw"), pick("venue").cast("string").alias("venue_raw"), pick("url").cast("string").alias("url"), pick("description").cast("string").alias("description"))
        out = own if out is None else out.unionByName(own)
    return out


def load_shows(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The shows (pos, body) of each known source from ``<source>.json`` in a
    folder, in the order of preference; each document is cut by byte ranges, so it
    may be of any size. Other files are passed over, missing ones left out."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return {s: read_members(spark, f"{path}/{s}.json") for s in SOURCE_PRIORITY if exists(spark, f"{path}/{s}.json")}


def _at(field: str) -> str:
    return "$." + ".".join(f"['{x}']" if not x.isidentifier() else x for x in field.split("."))


def extract_shows(shows: dict[str, DataFrame], fields=SHOW_FIELDS) -> DataFrame:
    """The same records as ``extract_records`` from shows (pos, body), a row each.
    Where a field leads into a struct and a source gives a plain value, that is it."""
    out = None
    for rank, (source, own) in enumerate(shows.items()):
        names = fields[source]
        rows = own.select((F.lit(rank * SOURCE_ROWS) + c("pos")).cast("long").alias("rec_id"), F.lit(source).alias("source"), *[_value(names[k]).alias(as_) for k, as_ in RECORD_FIELDS])
        out = rows if out is None else out.unionByName(rows)
    return out


def extract_show_performances(shows: DataFrame, source: str, rank: int, schema: str, fields=SHOW_FIELDS) -> DataFrame:
    """The performances (of a ``schema``) of one source's shows, with rec_id and raw_ord (their place in the show)."""
    own = F.from_json(F.get_json_object("body", _at(fields[source]["performances"])), f"array<struct<{schema}>>")
    rows = shows.select((F.lit(rank * SOURCE_ROWS) + c("pos")).cast("long").alias("rec_id"), F.posexplode(own).alias("raw_ord", "p"))
    return rows.select("rec_id", "raw_ord", "p.*")


def _value(field: str):
    """A field of a show's body; of one inside a struct also the plain value that stands in the struct's place."""
    found, outer = F.get_json_object("body", _at(field)), field.split(".")[0]
    if outer == field:
        return found
    whole = F.get_json_object("body", _at(outer))
    return F.coalesce(found, F.when(~F.startswith(whole, F.lit("{")), whole))


def _field(column, kind: T.DataType, path: str):
    """A nested field, or null; a struct's field is the value itself where the source gives a plain text."""
    for name in path.split("."):
        if isinstance(kind, T.StringType):
            return column
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None)
        column, kind = column[name], kind[name].dataType
    return column


def extract_performances(payload: DataFrame, source: str, rank: int, fields=SHOW_FIELDS) -> DataFrame:
    """The performances of one source with rec_id and raw_ord (their place in the show)."""
    shows = payload.select(F.posexplode("shows").alias("pos", "s"))
    name = fields[source]["performances"]
    rows = shows.select((F.lit(rank) * 1_000_000_000 + c("pos")).cast("long").alias("rec_id"), F.posexplode(c("s")[name]).alias("raw_ord", "p"))
    return rows.select("rec_id", "raw_ord", "p.*")


def load_overrides(spark: SparkSession, path: str | None) -> dict:
    """Manual rules from JSON or YAML; none without a file; a section that is null is empty."""
    if not path or not exists(spark, path):
        return {"force_split": [], "force_merge": []}
    body = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML rules need the yaml library; JSON rules don't") from e
        found = yaml.safe_load(body) or {}
    else:
        found = json.loads(body)
    return {k: list(found.get(k) or []) for k in ("force_split", "force_merge")}


#: Error conditions of a table that is missing, has no rows to tell its columns, lacks columns, or isn't one.
NO_TABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN", "FAILED_READ_FILE")


def _no_table(e: PySparkException | Py4JJavaError) -> bool:
    """Whether a failure, or what caused it, is one of these conditions."""
    if isinstance(e, PySparkException):
        return (e.getCondition() or "").startswith(NO_TABLE)
    cause = e.java_exception
    while cause is not None:
        if (cause.getMessage() or "").startswith(tuple(f"[{c}" for c in NO_TABLE)):
            return True
        cause = cause.getCause()
    return False


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """The history table, or an empty one if it is missing or can't be read as one. Other failures are raised."""
    try:
        return spark.read.parquet(path).select(*T._parse_datatype_string(HISTORY_SCHEMA).names)
    except (PySparkException, Py4JJavaError) as e:
        if not _no_table(e):
            raise
        return spark.createDataFrame([], HISTORY_SCHEMA)


HISTORY_JSON = "struct<shows: map<string, map<string, array<struct<t: string, min: double, max: double, currency: string, any_available: boolean>>>>>"


def history_from_json(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """A nested history document (shows, then ``DATETTIME`` keys, then rows), or
    one in each line if it isn't a ``whole`` one, as flat rows; keys without a date and time are left out."""
    doc = spark.read.text(path, wholetext=whole).select(F.from_json("value", HISTORY_JSON).alias("d"))
    perfs = doc.select(F.explode("d.shows").alias("show_id", "perfs")).select("show_id", F.explode("perfs").alias("key", "rows"))
    flat = perfs.where(c("key").rlike(r"^\d{4}-\d{2}-\d{2}T")).select("show_id", F.substring("key", 1, 10).alias("date"), F.expr("substring(key, 12)").alias("time"), F.posexplode("rows").alias("seq", "r"))
    return flat.select("show_id", "date", "time", "r.t", (c("seq") + 1).cast("long").alias("seq"), "r.min", "r.max", "r.currency", "r.any_available")


def history_to_json(history: DataFrame) -> DataFrame:
    """One compact JSON text for each show: the rows of its performances by ``DATETTIME``. The document stays cut by show, so no task holds all of it."""
    rows = history.groupBy("show_id", F.concat("date", F.lit("T"), "time").alias("key")).agg(F.array_sort(F.collect_list(F.struct("seq", "t", "min", "max", "currency", "any_available"))).alias("r"))
    each = rows.select("show_id", F.struct("key", F.transform("r", lambda x: F.struct(x["t"].alias("t"), x["min"].alias("min"), x["max"].alias("max"), x["currency"].alias("currency"), x["any_available"].alias("any_available"))).alias("value")).alias("e"))
    return each.groupBy("show_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e")))).alias("value"))


def run_ids(spark: SparkSession, path: str) -> list[str]:
    """The runs of a folder in order; none if there is no such folder."""
    base, fs = _fs(spark, path)
    if not fs.exists(base):
        return []
    return sorted(n.removeprefix("run_id=") for s in fs.listStatus(base) if (n := s.getPath().getName()).startswith("run_id="))


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if there is one."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def drop_runs(spark: SparkSession, path: str, runs: list[str]) -> None:
    for r in runs:
        drop(spark, f"{path}/run_id={r}")


def staging(path: str, run_id: str) -> str:
    """Where a run is written before it is published."""
    return f"{path}/_staging-{run_id}"


def publish(spark: SparkSession, path: str, run_id: str) -> None:
    """Makes a staged run one of the folder's runs, in place of one of its name."""
    src, fs = _fs(spark, staging(path, run_id))
    to, _ = _fs(spark, f"{path}/run_id={run_id}")
    fs.delete(to, True)
    fs.rename(src, to)


def write_run(df: DataFrame, path: str, run_id: str, keep: int | None = 5) -> list[str]:
    """Writes a run beside the earlier ones (``run_id=...``) through a staging
    folder, so that readers see whole runs only, and drops all but the last
    ``keep`` (none without it). Returns the runs that are left."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(staging(path, run_id))
    publish(spark, path, run_id)
    runs = run_ids(spark, path)
    if keep is not None:
        drop_runs(spark, path, runs[:-keep])
    return runs if keep is None else runs[-keep:]


def has_run(spark: SparkSession, path: str) -> bool:
    return bool(run_ids(spark, path))


def read_run(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A run, the last one by default."""
    return spark.read.parquet(f"{path}/run_id={run_id or run_ids(spark, path)[-1]}")


def write_export(df: DataFrame, path: str) -> None:
    """Gzipped JSON lines without spaces."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def read_export(spark: SparkSession, path: str, history: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """An export, and a history beside it if there is one; a history that is missing is no error."""
    return spark.read.json(path), spark.read.json(history) if history and exists(spark, history) else None


def save_cache(df: DataFrame, path: str) -> bool:
    """Writes a cache whole or not at all; says whether it did. A cache that can't
    be written costs time, nothing else, so Spark's failures are logged and not raised."""
    try:
        write_run(df, path, datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S%f"), keep=1)
        return True
    except (PySparkException, Py4JJavaError) as e:
        log.warning("cache not written to %s: %s", path, e)
        return False


def load_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache, or an empty one where there is none or one of other columns."""
    empty = spark.createDataFrame([], schema)
    if not has_run(spark, path):
        return empty
    try:
        return read_run(spark, path).select(*empty.columns)
    except (PySparkException, Py4JJavaError) as e:
        if not _no_table(e):
            raise
        return empty


#: The runs of a cache that hold all of it, not only changes.
WHOLE_CACHE = "-whole"


def stamp() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def changed_entries(cache: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """Those of the fresh entries that the cache hasn't, or has otherwise."""
    rest = [x for x in fresh.columns if x != key]
    known = cache.select(key, F.struct(*rest).alias("__known"))
    return fresh.join(known, key, "left").where(~F.struct(*rest).eqNullSafe(c("__known"))).select(*fresh.columns)


def save_changes(changed: DataFrame, path: str, removed: DataFrame | None = None, key: str = "key") -> list[str]:
    """Writes new and replaced entries, and tombstones for the removed keys, as a
    run beside the earlier ones; nothing else is written again."""
    rows = changed.withColumn("gone", F.lit(False))
    if removed is not None:
        rows = rows.unionByName(removed.select(key).distinct().withColumn("gone", F.lit(True)), allowMissingColumns=True)
    return write_run(rows, path, stamp(), keep=None)


def load_changes(spark: SparkSession, path: str, schema: str, key: str = "key") -> DataFrame:
    """The cache as all its runs give it: of each key the entry of the last run, unless that removed it."""
    empty = spark.createDataFrame([], schema)
    runs = run_ids(spark, path)
    whole = [i for i, r in enumerate(runs) if r.endswith(WHOLE_CACHE)]
    runs = runs[whole[-1] :] if whole else runs
    if not runs:
        return empty
    rows = spark.read.schema(f"{schema}, gone boolean, run_id string").option("basePath", path).parquet(*[f"{path}/run_id={r}" for r in runs])
    rest = [x for x in empty.columns if x != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest, "gone"), "run_id").alias("x")).where("not x.gone")
    return last.select(*[c(key) if x == key else c(f"x.{x}").alias(x) for x in empty.columns])


def compact_changes(spark: SparkSession, path: str, schema: str, live=None, key: str = "key") -> None:
    """Writes the cache as one run without what was replaced or removed, nor what
    isn't ``live`` (a condition, such as an age) any more, and drops the runs before it. Readers see either."""
    before = run_ids(spark, path)
    rows = load_changes(spark, path, schema, key)
    write_run((rows if live is None else rows.where(live)).withColumn("gone", F.lit(False)), path, stamp() + WHOLE_CACHE, keep=None)
    drop_runs(spark, path, before)


def failures(expected: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Pages that were to be parsed and weren't, as rows."""
    return expected.join(parsed.select(key), key, "left_anti").withColumn("failure", F.lit("missing: no parsed page"))


def catalogue_payload(shows: DataFrame, perfs: DataFrame, offers: DataFrame) -> DataFrame:
    """Shows with their performances, and these with a map of offers by source: the nested form, for export only."""
    by_source = offers.groupBy("show_id", "date", "time").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.struct("price_from", "price_to", "currency", "book_url", "available"))))).alias("sources"))
    perf = F.struct("date", "time", "min_price", "max_price", "currency", "any_available", F.to_json("sources").alias("sources"))  # text, since maps can't be sorted
    nested = perfs.join(by_source, ["show_id", "date", "time"], "left").groupBy("show_id").agg(F.sort_array(F.collect_list(perf)).alias("performances"))
    return shows.join(nested, "show_id", "left")


def report(spark: SparkSession, lines: dict[str, DataFrame], rows: int = 20) -> str:
    """A plain text of small tables: the first ``rows`` of each, and how many more there are."""
    out = []
    for title, df in lines.items():
        out.append(title)
        first = df.limit(rows + 1).collect()
        out += ["  " + " | ".join("" if v is None else str(v) for v in r) for r in first[:rows]]
        if len(first) > rows:
            out.append(f"  ... and {df.count() - rows} more")
    return "\n".join(out) + "\n"
