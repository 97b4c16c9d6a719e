"""Listings in pages: the end is found by few looks, many tasks read, and a stream goes on where it stopped."""

import json

import pytest

from quotegrid.sources import paged


def pages(folder, rows, limit, beyond):
    """The pages of a listing; beyond its end they are missing, empty, or say the last rows again."""
    for at in range(0, len(rows), limit):
        (folder / f"page-{at}.json").write_text(json.dumps(rows[at : at + limit]))
    end = -(-len(rows) // limit) * limit
    if beyond != "missing":
        for at in range(end, end + 40 * limit, limit):
            (folder / f"page-{at}.json").write_text(json.dumps([] if beyond == "empty" else rows[-limit:]))


@pytest.mark.parametrize("n", [0, 1, 5, 6, 37, 130])
@pytest.mark.parametrize("beyond", ["missing", "empty", "again"])
def test_end(tmp_path, n, beyond):
    pages(tmp_path, [{"id": i} for i in range(n)], 5, beyond)
    found = paged.PagedReader({"path": str(tmp_path), "limit": "5"})
    looks = []
    fetch = found.fetch
    found.fetch = lambda page: looks.append(page) or fetch(page)
    assert found.rows() == n and len(looks) <= 30
    assert sorted(x for p in found.partitions() for x in found.read(p)) == sorted((str(i), i, json.dumps({"id": i})) for i in range(n))
    assert found.rows(n) == n


def test_many_tasks(spark, tmp_path):
    pages(tmp_path, [{"id": i} for i in range(2000)], 4, "again")
    spark.dataSource.register(paged.PagedJson)
    read = spark.read.format("paged_json").option("path", str(tmp_path)).option("limit", "4").load()
    assert read.rdd.getNumPartitions() == 250 and read.count() == 2000


def test_shifted_rows(spark, tmp_path):
    """A row that stands again far below is left out by ``listing``."""
    pages(tmp_path, [{"id": i} for i in [0, 1, 2, 3, 1, 4, 5, 0, 6, 7]], 2, "missing")
    got = {r.key: r.pos for r in paged.listing(spark, str(tmp_path), limit="2").collect()}
    assert got == {"0": 0, "1": 1, "2": 2, "3": 3, "4": 5, "5": 6, "6": 8, "7": 9}


def test_stream_goes_on(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    spark.dataSource.register(paged.PagedJson)

    def run():
        rows = spark.readStream.format("paged_json").option("path", str(folder)).option("limit", "3").load()
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.pos, r.key) for r in spark.read.schema("key string, pos int, body string").parquet(out).collect())

    for n in (4, 5, 11):  # the last page fills up, and others follow
        pages(folder, [{"id": f"k{i}"} for i in range(n)], 3, "missing")
        assert run() == [(i, f"k{i}") for i in range(n)]
