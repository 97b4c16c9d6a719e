"""Documents read by byte ranges against whole parsing."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotegrid.sources import documents as D

TEXT = st.text(st.sampled_from('ab"\\{}[],: \n日é'), max_size=8)
VALUE = st.recursive(TEXT | st.integers() | st.none(), lambda x: st.lists(x, max_size=3) | st.dictionaries(TEXT, x, max_size=3), max_leaves=8)


def read(spark, path, size, field="shows"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = D.read_members(spark, str(path), field).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304")
    assert [r.pos for r in rows] == list(range(len(rows)))
    return [json.loads(r.body) for r in rows]


def odd(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice('ab"\\{}[],: \n日é') for _ in range(rnd.randrange(12)))
    shows = [{"id": i, "t": word(), "p": [{"x": word()} for _ in range(rnd.randrange(4))], word(): {"k": [[], {}, word()]}} for i in range(60)]
    shows[7]["long"] = "}" * 3000 + '"{' * 500
    return {"meta": {"shows": [{"no": 1}], "s": '"shows":['}, "other": [{"a": 1}, {"b": [{"c": 2}]}], "shows": shows, "after": [{"z": "}"}], "n": 3}


@pytest.mark.parametrize("size", [97, 700, 5000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_any_cut(spark, tmp_path, size, indent):
    doc = odd(size)
    (tmp_path / "x.json").write_text(json.dumps(doc, ensure_ascii=False, indent=indent))
    assert read(spark, tmp_path / "x.json", size) == doc["shows"]


@pytest.mark.parametrize("text", ['{"shows":[]}', '{"shows":null}', "{}", "", '{"shows":[1,"}",null]}', '{"a":[{"shows":[{"x":1}]}]}\n\n', '{"shows":{"a":{"b":1}}}'])
def test_without_members(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert read(spark, tmp_path / "x.json", 64) == []


def test_other_fields(spark, tmp_path):
    doc = odd(3)
    (tmp_path / "x.json").write_text(json.dumps(doc))
    assert read(spark, tmp_path / "x.json", 300, "other") == doc["other"] and read(spark, tmp_path / "x.json", 300, "after") == doc["after"]


@settings(max_examples=200, deadline=None)
@given(VALUE, st.integers(0, 200))
def test_brackets_at_any_cut(value, cut):
    """Two halves give together what the whole gives, whatever stands at the cut (but behind a backslash)."""
    data = np.frombuffer(json.dumps(value, ensure_ascii=False).encode(), np.uint8)
    cut = min(cut, len(data))
    while cut and data[cut - 1] == 92:
        cut -= 1
    at, deltas, inside = D.brackets(data, False)
    assert not inside and deltas.sum() == 0
    first, d1, middle = D.brackets(data[:cut], False)
    second, d2, end = D.brackets(data[cut:], middle)
    assert not end and np.concatenate((first, second + cut)).tolist() == at.tolist() and np.concatenate((d1, d2)).tolist() == deltas.tolist()


def test_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(500).select("id", F.concat(F.lit('"}{['), "id").alias("t")).repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    D.write_document(rows, f"{tmp_path}/doc", "id")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "doc").glob("part-*"))) > 2
    assert read(spark, tmp_path / "doc", 1000) == [{"t": f'"}}{{[{i}'} for i in range(500)]
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))
    assert len(whole["shows"]) == 501 and whole["shows"][0] is None
