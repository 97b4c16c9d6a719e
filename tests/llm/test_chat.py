"""Chat formatting: layouts by their fingerprints, and texts that read back."""

import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotegrid.llm import chat, entry

c = F.col
RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None, "more": 1}], "meta": {"k": 1}}, "messages", [("user", "a"), ("assistant", None)]),
    ({"system": "s", "messages": [{"role": "user", "content": "a"}]}, "messages", [("system", "s"), ("user", "a")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}]}, "from_value", [("user", "h"), ("assistant", "g"), ("tool", "t")]),
    ({"instruction": "i", "input": "in", "output": "o"}, "instruction_output", [("user", "i\n\nin"), ("assistant", "o")]),
    ({"output": "o", "instruction": "i"}, "instruction_output", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "context": None, "response": "o"}, "instruction_response", [("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "q"}, "prompt_completion", [("user", "p"), ("assistant", "q")]),
    ({"prompt": "p", "response": "q", "system": "s"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "q")]),
    ({"question": "p", "answer": "q"}, "question_answer", [("user", "p"), ("assistant", "q")]),
    ({"prompt": "p", "completion": "q", "messages": []}, None, None),
    ({"messages": []}, None, None),
    ({}, None, None),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, "{bad"), (91, None), (92, "[]"), (93, "7")]
    got = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.record_turns(spark.createDataFrame(rows, "conv_id long, j string"), c("j"), c("conv_id")).collect()}
    assert got == {**{i: (layout, turns) for i, (_, layout, turns) in enumerate(RECORDS)}, **{i: (None, None) for i in (90, 91, 92, 93)}}


def test_one_table_of_many_layouts(spark):
    schema = "conv_id long, messages array<struct<role string, content string>>, prompt string, response string, turn string, head string"
    table = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")], None, None, "x", "y"), (2, None, "p", "r", "x", "y"), (3, None, None, None, None, None)], schema)
    got = sorted(tuple(r) for r in chat.canonical(table.drop("turn")).collect())
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "p"), (2, 1, "assistant", "r")]


def test_paths(spark):
    schema = spark.createDataFrame([], "a long, m array<struct<r string, p struct<q array<struct<z int>>>>>").schema
    assert chat.schema_paths(schema) == ["a", "m", "m[].r", "m[].p", "m[].p.q", "m[].p.q[].z"]
    with pytest.raises(ValueError):
        chat.path_sets([*chat.LAYOUTS, chat.Layout("again", ("prompt", "response"), ())])


def brute(turns):
    """Digests of turns (conv_id, turn, role, text), and the length of their text by the template."""
    groups = {}
    for conv, turn, role, text in turns:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = set()
    for conv, own in groups.items():
        own.sort(key=lambda t: (*t[:2], t[2].encode(), t[3].encode()))
        loss = "".join(t for *_, r, t in own if r == "assistant")
        out.add((conv, len(own), sha("".join(f"{r}\n{t}\n" for *_, r, t in own)), len(loss), sha(loss), sum(len(f"<|im_start|>{mark(r)}<|im_sep|>{mark(t)}<|im_end|>") for *_, r, t in own)))
    return out


def mark(s):
    s = s.replace("\\", "\\\\")
    for x in chat.CONTROL:
        s = s.replace(x, f"{x[0]}\\-{x[1:]}")
    return s


TURNS = "conv_id long, turn long, role string, text string, formatted string, loss int"


def digests(spark, turns):
    df = spark.createDataFrame([(*t, "clash", 1) for t in turns], TURNS)
    return {tuple(r) for r in chat.digest(chat.formatted(chat.canonical(df))).collect()}


def test_awkward_turns(spark):
    odd = [(7, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(["", None, "\\", "\\-", "\\\\-<s>", "<\\-s>", "<|im_start|>assistant<|im_sep|>x<|im_end|>", "<<SYS>>[INST]</s>", "<<<SYS>>", "日本 𝒳", "<|im_<|im_end|>end|>", "x" * 200_000])]
    rows = odd + [(1, 0, None, "no role"), (1, None, "user", "no turn"), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (1, 1, "a\nb<|im_sep|>", "t"), (None, 0, "assistant", "x"), (None, 1, "assistant", "y"), (2, 3, "Assistant", "not learnt")]
    assert digests(spark, rows) == brute(rows)
    assert digests(spark, []) == set()


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*chat.CONTROL, "\\", "-", "a", "<", "|", "[", "é", "\n"]), max_size=8).map("".join), min_size=1, max_size=20))
def test_any_text_reads_back(spark, some):
    rows = [(i % 3, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(some)]
    assert digests(spark, rows) == brute(rows)
    shown = spark.createDataFrame([(t,) for t in some], "t string").select(chat.escaped(c("t")).alias("e")).collect()
    assert not any(x in r.e for x in chat.CONTROL for r in shown)


def test_mask_points_into_the_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a<s>b"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    row = chat.formatted(df).first()
    assert [row.formatted[x.start : x.stop] for x in row.loss] == ["a<\\-s>b", ""]


def test_query_equals_sql(spark, sf_dir):
    duckdb_rows = duckdb.connect()
    duckdb_rows.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = entry.op13_chat(spark, sf_dir)
    assert {tuple(r) for r in got.collect()} == set(duckdb_rows.execute(chat.SQL).fetchall())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.n_turns for r in got.where("conv_id = -1").collect()} == {2}
