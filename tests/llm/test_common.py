"""Hot keys, streamed groups and components."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quotegrid.llm import common
from quotegrid.llm.components import components


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how):
    rows = [(1, i, "x") for i in range(3000)] + [(2, i, "y") for i in range(50)] + [(None, 0, "n"), (9, 0, "z")]
    left = common.written(spark.createDataFrame(rows, "k int, v int, s string"))
    right = spark.createDataFrame([(1, 10.0), (2, 20.0), (2, 21.0), (3, 30.0)], "k int, w double")
    assert [tuple(r) for r in common.hot_keys(left, ["k"]).collect()] == [(1, 3)]
    got = Counter(map(tuple, common.spread_join(left, right, ["k"], how).select("k", "v", "s", "w").collect()))
    assert got == Counter(map(tuple, left.join(right, "k", how).select("k", "v", "s", "w").collect()))
    assert common.hot_keys(left.limit(0), ["k"]) is None and common.spread_join(left.limit(0), right, ["k"], how).collect() == []


@pytest.mark.parametrize("at_once", [1, 5, 1000])
def test_whole_groups(at_once):
    rnd = np.random.default_rng(3)
    keys = np.repeat(np.arange(40), rnd.integers(1, 30, 40))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7] // 4), pa.array(keys[i : i + 7]), pa.array(np.arange(i, min(i + 7, len(keys))))], ["a", "b", "at"]) for i in range(0, len(keys), 7)]
    empty = batches[0].slice(0, 0)
    got = list(common.whole_groups(iter([empty, *batches, empty]), ["a", "b"], at_once))
    assert np.concatenate([np.asarray(t.column("at")) for t in got]).tolist() == list(range(len(keys)))
    seen = [set(np.asarray(t.column("b")).tolist()) for t in got]
    assert all(not (x & y) for i, x in enumerate(seen) for y in seen[:i])
    assert list(common.whole_groups(iter([empty]), ["a"])) == []


def test_components_of_a_star_and_a_chain(spark):
    star = spark.range(1, 100_001).selectExpr("5000000 + id as a", "0L as b")
    chain = spark.range(1000).selectExpr("10000000 + id as a", "10000001 + id as b")
    same = spark.createDataFrame([(7, 7), (20, 21), (21, 20), (20, 21)], "a long, b long")
    got = components(star.union(chain).union(same))
    assert {tuple(r) for r in got.groupBy("label").count().collect()} == {(0, 100_001), (10_000_000, 1001), (20, 2)}


def test_components_of_a_chain_numbered_at_random(spark):
    p = np.random.default_rng(1).permutation(600).tolist()
    got = components(spark.createDataFrame(list(zip(p, p[1:])), "a long, b long"))
    assert {tuple(r) for r in got.groupBy("label").count().collect()} == {(0, 600)}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Remote:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Remote)
