import datetime
import json
import zipfile

from quotegrid.operators import history as H
from quotegrid.sources import catalog
from quotegrid.streaming import history as stream

PAYLOADS = {
    "olt": {"scraped_at": "2026-01-01T00:00:00", "source": "olt", "shows": [{"id": 1, "title": "A", "venue": {"name": "Old Vic", "url": "u"}, "url": "x", "performances": [{"date": "2026-05-01", "time": "19:00", "min_price": 20.0}]}]},
    "ttd": {"source": "ttd", "shows": [{"id": 9, "title": "B", "venue_name": "Young Vic", "performances": [{"date": "2026-05-01", "price": 5.0}]}]},
}


def write(folder):
    for name, body in {**PAYLOADS, "other": {"shows": []}}.items():
        (folder / f"{name}.json").write_text(json.dumps(body))
    return str(folder)


def test_load_sources(spark, tmp_path):
    folder = write(tmp_path)
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for name in PAYLOADS:
            z.write(tmp_path / f"{name}.json", f"data/{name}.json")
    for path in (folder, str(tmp_path / "all.zip")):
        sources = catalog.load_sources(spark, path)
        assert list(sources) == ["olt", "ttd"]
        rows = catalog.extract_records(sources).orderBy("rec_id").collect()
        assert [(r.source, r.source_id, r.title_raw, r.venue_raw, r.url) for r in rows] == [("olt", "1", "A", "Old Vic", "x"), ("ttd", "9", "B", "Young Vic", None)]
        perfs = catalog.extract_performances(sources["olt"], "olt", 0).collect()
        assert [(p.rec_id, p.raw_ord, p.date, p.min_price) for p in perfs] == [(0, 0, "2026-05-01", 20.0)]
    try:
        catalog.load_sources(spark, str(tmp_path / "nowhere"))
        raise AssertionError
    except FileNotFoundError:
        pass


def test_rules_and_caches(spark, tmp_path):
    assert catalog.load_overrides(spark, None) == {"force_split": [], "force_merge": []} == catalog.load_overrides(spark, str(tmp_path / "no.json"))
    (tmp_path / "r.json").write_text('{"force_split": null, "force_merge": [{"records": []}]}')
    assert catalog.load_overrides(spark, str(tmp_path / "r.json")) == {"force_split": [], "force_merge": [{"records": []}]}
    assert catalog.load_history(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    assert catalog.load_history(spark, str(tmp_path / "bad")).count() == 0
    df = spark.range(3).withColumnRenamed("id", "k")
    assert catalog.save_cache(df, str(tmp_path / "cache")) and catalog.load_cache(spark, str(tmp_path / "cache"), "k long").count() == 3
    assert catalog.load_cache(spark, str(tmp_path / "missing"), "k long").count() == 0


def test_runs_rotate(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(7):
        kept = catalog.write_run(spark.range(i + 1), path, f"{i:03d}", keep=5)
    assert kept == ["002", "003", "004", "005", "006"] and catalog.read_run(spark, path).count() == 7 and catalog.read_run(spark, path, "003").count() == 4
    catalog.write_run(spark.range(2), path, "006")  # the same run again takes its place
    assert catalog.read_run(spark, path).count() == 2


def test_exports(spark, tmp_path):
    catalog.write_export(spark.range(4), str(tmp_path / "out"))
    got, none = catalog.read_export(spark, str(tmp_path / "out"), str(tmp_path / "no"))
    assert got.count() == 4 and none is None and all(p.name.endswith(".json.gz") for p in (tmp_path / "out").glob("part-*"))
    doc = {"shows": {"s": {"2026-05-01T19:00": [{"t": "r1", "min": 5.0, "max": None, "currency": "GBP", "any_available": None}, {"t": "r2", "min": 4.0}], "bad": [{"t": "x"}]}}}
    (tmp_path / "h.json").write_text(json.dumps(doc))
    flat = catalog.history_from_json(spark, str(tmp_path / "h.json"))
    assert [(r.date, r.time, r.t, r.seq, r.min) for r in flat.orderBy("seq").collect()] == [("2026-05-01", "19:00", "r1", 1, 5.0), ("2026-05-01", "19:00", "r2", 2, 4.0)]
    back = json.loads(catalog.history_to_json(flat).first().value)
    assert [x["t"] for x in back["2026-05-01T19:00"]] == ["r1", "r2"]
    shows = spark.createDataFrame([("s", "T")], "show_id string, title string")
    perfs = spark.createDataFrame([("s", "d", "t", 1.0, 2.0, "GBP", True)], "show_id string, date string, time string, min_price double, max_price double, currency string, any_available boolean")
    offers = spark.createDataFrame([("s", "d", "t", "olt", 1.0, None, "GBP", "u", True)], "show_id string, date string, time string, source string, price_from double, price_to double, currency string, book_url string, available boolean")
    out = catalog.catalogue_payload(shows, perfs, offers).first()
    assert json.loads(out.performances[0].sources)["olt"]["price_from"] == 1.0
    assert catalog.report(spark, {"shows": shows}) == "shows\n  s | T\n"
    assert catalog.failures(shows, shows.limit(0), "show_id").count() == 1


def test_streaming_changes(spark, tmp_path):
    kind = "show_id string, date string, time string, t string, seen_at timestamp, min double, max double, any_available boolean"
    when = lambda h: datetime.datetime(2026, 1, 1, h)
    batches = [
        [("s", "2026-02-01", "19:00", "r1", when(1), 5.0, None, True)],
        [("s", "2026-02-01", "19:00", "r1", when(1), 6.0, None, True), ("s", "2026-02-01", "19:00", "r2", when(2), 5.0, None, True)],
        [("s", "2026-02-01", "19:00", "r3", when(3), 4.0, None, True), ("z", "2026-02-01", "19:00", "r3", when(3), None, None, None)],
    ]
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(src / f"b={i}"))
    q = None
    snaps = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(src / "b=*"))
    q = stream.changes(snaps).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.show_id, r.t, r.min, r.seq) for r in spark.table("changes").collect()) == [("s", "r1", 5.0, 1), ("s", "r3", 4.0, 2), ("z", "r3", None, 1)]


def test_streaming_batches_equal_batch(spark, tmp_path):
    kind = H.SCHEMA.replace(" seq long,", "")
    src = [("olt", 5.0, None, None)]
    runs = [[("s", "2026-02-01", "19:00", f"r{i}", p, None, "GBP", None, src)] for i, p in enumerate((5.0, 5.0, 4.0))]
    folder = tmp_path / "in"
    whole = spark.createDataFrame([], H.SCHEMA)
    for i, rows in enumerate(runs):
        df = spark.createDataFrame(rows, kind)
        df.coalesce(1).write.parquet(str(folder / f"b={i}"))
        whole = H.append(whole, df)
    q = stream.append_batches(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder / "b=*")), str(tmp_path / "h"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = stream.read_history(spark, str(tmp_path / "h"))
    assert sorted((r.t, r.seq, r.min) for r in got.collect()) == sorted((r.t, r.seq, r.min) for r in whole.collect()) == [("r0", 1, 5.0), ("r2", 2, 4.0)]


def test_streaming_history_grows_by_what_changed(spark, tmp_path):
    """Runs hold what their batch appended; a compaction folds them, and a run that can't be read stops the stream."""
    kind = H.SCHEMA.replace(" seq long,", "")
    folder, path = tmp_path / "in", str(tmp_path / "h")
    rows = lambda i: [(f"s{k}", "2026-02-01", "19:00", f"r{i}", float(i if k == 1 else 0), None, "GBP", None, [("olt", 5.0, None, None)]) for k in range(3)]
    whole = spark.createDataFrame([], H.SCHEMA)

    def feed(i):
        df = spark.createDataFrame(rows(i), kind)
        df.coalesce(1).write.parquet(str(folder / f"b={i}"))
        return df

    def run():
        q = stream.append_batches(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder / "b=*")), path, str(tmp_path / "cp"), compact_every=3)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for i in range(5):
        whole = H.append(whole, feed(i))
    run()
    key = lambda df: sorted((r.show_id, r.t, r.seq, r.min) for r in df.collect())
    assert key(stream.read_history(spark, path)) == key(whole) and len(key(whole)) == 7
    runs = catalog.run_ids(spark, path)
    assert runs == ["0000000003-whole", "0000000004"]  # the runs before the compaction went when the next epoch began
    assert spark.read.parquet(f"{path}/run_id=0000000004").count() == 1
    for f in (tmp_path / "h" / "run_id=0000000004").glob("*.parquet"):
        f.write_text("broken")
    feed(5)
    try:
        run()
        raise AssertionError("a history that can't be read must stop the stream")
    except Exception as e:  # noqa: BLE001  whatever Spark calls it
        assert not isinstance(e, AssertionError)
    assert catalog.run_ids(spark, path) == runs


def test_report_tells_what_it_leaves_out(spark):
    assert catalog.report(spark, {"n": spark.range(5)}, rows=2) == "n\n  0\n  1\n  ... and 3 more\n"


def test_streaming_floors(spark, tmp_path):
    kind = "show_id long, price_from double, available boolean, seen_at timestamp"
    spark.createDataFrame([(1, 5.0, None, datetime.datetime(2026, 1, 1, 1)), (2, 3.0, False, datetime.datetime(2026, 1, 1, 2)), (2, 4.0, True, datetime.datetime(2026, 1, 1, 3))], kind).write.parquet(str(tmp_path / "in"))
    q = stream.floors(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("floors").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.floor, r.n, r.shows) for r in spark.table("floors").collect()] == [(4.0, 2, 2)]


def test_paged_source(spark, tmp_path):
    from quotegrid.sources.paged import PagedJson

    spark.dataSource.register(PagedJson)
    for o, ids in ((0, [1, 2]), (2, [3, 4]), (4, [4, 5]), (6, [5])):
        (tmp_path / f"page-{o}.json").write_text(json.dumps([{"id": i} for i in ids]))
    read = spark.read.format("paged_json").option("path", str(tmp_path)).option("limit", "2")
    assert sorted((r.key, r.pos) for r in read.load().collect()) == [("1", 0), ("2", 1), ("3", 2), ("4", 3), ("5", 5)]  # the last page brings nothing new
    known = read.option("total", "4").load()
    assert known.rdd.getNumPartitions() == 2 and sorted(r.key for r in known.collect()) == ["1", "2", "3", "4"]


def test_conform(spark):
    from quotegrid.sources import schemas

    df = spark.createDataFrame([("7", "x", 1.5, "extra")], "show_id string, show_ord string, price_from double, other string")
    got = schemas.conform(df, schemas.OFFER)
    assert got.columns[:3] == ["show_id", "show_ord", "date"] and "other" not in got.columns
    r = got.first()
    assert (r.show_id, r.show_ord, r.price_from, r.available) == (7, None, 1.5, None)
