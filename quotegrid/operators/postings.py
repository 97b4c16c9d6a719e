"""An index of three-letter pieces over short texts, for searches by substring.

``build`` writes two tables: postings (gram, key), dealt and sorted by gram so that
a reader skips all but its gram's row groups, and the number of postings of each
gram. A search takes its rarest gram only, reads that gram's postings, and checks
the texts of the keys found. Results are those of ``contains`` on lower-cased texts.

Texts end with two marks, so each place of a text begins a gram, and words of one
or two letters are found by the grams that begin with them. Null and empty texts
have no postings. Repeated rows are found as often as they stand there. Words that
are blank find nothing.

An index is kept up by runs beside it: ``add`` writes the postings of new and changed
rows alone, and the keys whose earlier postings don't count any more. A search reads
all runs, and since it checks the rows' own texts, postings of before cost time and
never a result; ``compact`` writes the index whole again without them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalog
from ..sources.session import stage
from .spread import dealt_join

c = F.col
N, MARK = 3, "\x00\x00"
#: Letters, or postings, of a task: it sorts them, and keeps them to leave out repeated ones, in some 100 bytes each.
TASK = 1_000_000
#: The runs that hold a whole index, not only changes.
WHOLE = "-whole"


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _pieces(letters: Column) -> Column:
    """The pieces of N letters at each place; linear in the text's length."""
    return F.transform(F.sequence(F.lit(1), F.size(letters) - (N - 1)), lambda i: F.array_join(F.slice(letters, i, F.lit(N)), ""))


def grams(text: Column) -> Column:
    """The distinct pieces of a text, lower-cased, each place of it beginning one; empty for null and empty texts."""
    low = F.lower(text)
    return F.when(F.coalesce(F.length(low), F.lit(0)) > 0, F.array_distinct(_pieces(_letters(F.concat(low, F.lit(MARK)))))).otherwise(F.array().cast("array<string>"))


def word_grams(words: Column) -> Column:
    """The pieces that a text must hold to hold lower-cased ``words``; those of fewer letters have one, themselves."""
    letters = _letters(words)
    return F.when(F.length(words) == 0, F.array().cast("array<string>")).when(F.length(words) < N, F.array(words)).otherwise(F.array_distinct(_pieces(letters)))


def asked(words: Column) -> Column:
    """Search words as they are looked for."""
    return F.lower(F.trim(F.coalesce(words, F.lit(""))))


def _tasks(spark: SparkSession, n: int | None) -> int | None:
    """How many tasks so many letters or postings take; None where Spark's own number does."""
    tasks = -(-(n or 0) // TASK)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` dealt by key over as many tasks as their letters take: texts of one
    small file give far more postings than one task should hold. What follows by key
    and gram needs no other shuffle."""
    letters = reduce(Column.__add__, [F.coalesce(F.length(x), F.lit(0)) for x in columns])
    n = rows.agg(F.sum(letters)).first()[0] or 0
    return rows.select(key, *columns).repartition(max(-(-n // TASK), rows.sparkSession.sparkContext.defaultParallelism), key)


def _posted(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return _dealt(rows, key, columns).select(c(key).alias("key"), F.explode(F.array_distinct(F.flatten(F.array(*[grams(c(x)) for x in columns])))).alias("gram")).distinct()


def _write(posted: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Postings in ranges of gram and key, and how many each gram has."""
    posted = stage(posted)  # read for the ranges, and again to be dealt by them
    files = files or _tasks(posted.sparkSession, posted.count())
    ranges = ("gram", "key") if files is None else (files, "gram", "key")
    posted.repartitionByRange(*ranges).sortWithinPartitions("gram", "key").write.mode(mode).parquet(f"{path}/postings")
    counts = posted.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode(mode).parquet(f"{path}/grams")


def build(rows: DataFrame, path: str, key: str, columns: Sequence[str], files: int | None = None) -> None:
    """Writes the index of ``columns`` of ``rows`` into a new folder. A gram that most
    texts hold is dealt over several files by key, since the ranges are of both.
    Without ``files`` Spark chooses how many there are."""
    _write(_posted(rows, key, columns), path, files, "error")


def _parts(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up the index, in order: the last whole one, if there is one, and the changes after it."""
    runs = catalog.run_ids(spark, path)
    whole = max((i for i, r in enumerate(runs) if r.endswith(WHOLE)), default=-1)
    changes = [f"{path}/run_id={r}" for r in runs[max(whole, 0) :]]
    return changes if whole >= 0 or not catalog.exists(spark, f"{path}/grams/_SUCCESS") else [path, *changes]


def _read(spark: SparkSession, parts: Sequence[str], table: str) -> DataFrame:
    return spark.read.parquet(*[f"{p}/{table}" for p in parts])


def add(rows: DataFrame, path: str, key: str, columns: Sequence[str], removed: DataFrame | None = None, run: str | None = None) -> None:
    """Adds new and changed ``rows`` to a stored index, and forgets keys that only
    ``removed`` has. Nothing written before is written again.

    All rows of a changed key must be given, since they replace what it had. A
    ``run`` of a name that is there already replaces it, so a repeated attempt adds
    nothing; by default runs are named by the time, and names give their order.
    """
    spark, run = rows.sparkSession, run or catalog.stamp()
    staged = catalog.staging(path, run)
    _write(_posted(rows, key, columns), staged)
    keys = rows.select(c(key).alias("key"))
    if removed is not None:
        keys = keys.unionByName(removed.select(c(key).alias("key")))
    keys.distinct().write.mode("overwrite").parquet(f"{staged}/keys")
    catalog.publish(spark, path, run)


def compact(spark: SparkSession, path: str, files: int | None = None) -> None:
    """Writes an index that has changes whole again, without the postings that later
    runs replaced. The parts it was made of stay for the searches that read them,
    until the next compaction begins."""
    parts = _parts(spark, path)
    runs = catalog.run_ids(spark, path)
    if parts[0] != path:
        catalog.drop_runs(spark, path, [r for r in runs if f"{path}/run_id={r}" < parts[0]])
        for table in ("postings", "grams"):
            catalog.drop(spark, f"{path}/{table}")
    if len(parts) == 1:
        return
    told = [_read(spark, [p], "keys").withColumn("since", F.lit(i)) for i, p in enumerate(parts) if i]
    since = reduce(DataFrame.unionByName, told).groupBy("key").agg(F.max("since").alias("since"))
    posted = reduce(DataFrame.unionByName, [_read(spark, [p], "postings").withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    n = _read(spark, parts, "grams").agg(F.sum("n")).first()[0]
    posted = posted.repartition(_tasks(spark, n) or int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
    live = posted.join(since, "key", "left").where(c("part") >= F.coalesce("since", F.lit(0))).select("key", "gram").distinct()
    whole = f"{runs[-1]}{WHOLE}"
    _write(live, catalog.staging(path, whole), files)
    catalog.publish(spark, path, whole)


def _held(columns: Sequence[str], words: Column) -> Column:
    found = [F.lower(F.coalesce(c(x), F.lit(""))).contains(words) for x in columns]
    return F.array_max(F.array(*found))


def lookup(rows: DataFrame, path: str, key: str, columns: Sequence[str], words: str) -> DataFrame:
    """The rows of which a column holds ``words``, in either case."""
    spark = rows.sparkSession
    w, pieces = spark.range(1).select(asked(F.lit(words)).alias("w"), word_grams(asked(F.lit(words))).alias("g")).first()
    if not pieces:
        return rows.where(F.lit(False))
    parts = _parts(spark, path)
    posted = _read(spark, parts, "postings")
    if len(w) < N:
        mine = posted.where(c("gram").startswith(w))
    else:
        found = _read(spark, parts, "grams").where(c("gram").isin(pieces)).groupBy("gram").agg(F.sum("n").alias("n"))
        counts = {r.gram: r.n for r in found.collect()}  # as many rows as the words have letters
        mine = posted.where(c("gram") == min(pieces, key=lambda g: (counts.get(g, 0), g)))
    return rows.join(mine.select(c("key").alias(key)).distinct(), key, "left_semi").where(_held(columns, F.lit(w)))


def lookup_all(rows: DataFrame, path: str, key: str, columns: Sequence[str], searches: DataFrame) -> DataFrame:
    """Many searches (search_id, words) at once: search_id and the rows that each finds.

    A search joins the postings of its rarest gram; a gram that many searches share
    and many texts hold is dealt over slots. Equal words are looked for once.
    """
    spark = rows.sparkSession
    parts = _parts(spark, path)
    posted, counts = _read(spark, parts, "postings"), _read(spark, parts, "grams")
    if len(parts) > 1:
        counts = stage(counts.groupBy("gram").agg(F.sum("n").alias("n")))
    told = searches.select("search_id", asked(c("words")).alias("_w")).where("_w <> ''")
    words = stage(told.select("_w").distinct())
    long_ = words.where(F.length("_w") >= N).select("_w", F.explode(word_grams(c("_w"))).alias("gram"))
    rare = long_.join(counts, "gram", "left").groupBy("_w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    begun = counts.select("gram", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("_w")).distinct()
    short = words.where(F.length("_w") < N).join(begun, "_w").select("_w", "gram")
    needed = stage(rare.unionByName(short))
    # the postings of grams that are asked for are written, because the join reads them twice
    mine = stage(posted.join(needed.select("gram").distinct(), "gram", "left_semi"))
    pairs = dealt_join(mine, needed, ["gram"]).select("_w", c("key").alias(key)).distinct()
    hits = stage(rows.join(pairs, key).where(_held(columns, c("_w"))))
    return dealt_join(hits, told, ["_w"]).select("search_id", *rows.columns)
