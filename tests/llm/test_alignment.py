"""Alignment against the libraries' own encodings, walked token by token."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, rows, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from quotegrid.llm import alignment, entry

ODD = ["<|endoftext|> x <s> </s>", "a▁b", "▁", " lead", "  two", "tab\tx\n\n y \r\n", "é́ ﬁ ﷺ 𝒳 👩‍👩‍👧", "\x00\x01", "x  y   z\n", "\n", "\n\nq\nr", "a" * 3000, "<0x41>", "don't  won't\n\n"]


@pytest.fixture(scope="module")
def both():
    paths = entry.tokenizer_path(), entry.tokenizer_path(entry.PIECES)
    return paths, *alignment.loaded(*paths)


def plain(tokenizers, text):
    """The ids of both, the groups and the links of a text."""
    if not text:
        return [], [], [], []
    t = tokenizers
    a, b = t.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    names_a, names_b = t.vocab_a.names, t.vocab_b.names
    if {b"".join(names_a[i] for i in a), b"".join(names_b[i] for i in b)} != {(" " + text).encode()}:
        return [], [], [], []
    groups, links, own_a, own_b, end_a, end_b, j = [], [], [], [], 0, 0, 0
    for i in a:
        own_a.append(i)
        end_a += len(names_a[i])
        while end_b < end_a:
            own_b.append(b[j])
            end_b += len(names_b[b[j]])
            j += 1
        if end_a == end_b:
            groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
            links.append((own_a[-1], own_b[-1]))
            own_a, own_b = [], []
    return a, b, groups, links


def check_chunk(both, some):
    (path_a, path_b), t, pairs = both
    n_a, n_b, n_links, groups, codes, counts = alignment.align_chunk(pa.array(some, pa.string()), path_a, path_b)
    for i, x in enumerate(some):
        a, b, want, links = plain(t, x)
        assert (len(a), len(b), len(links)) == (n_a[i], n_b[i], n_links[i]), x
        assert ";".join(want).encode() == bytes(groups[i]), x
        assert {divmod(int(pairs.keys[k]), pairs.width): n for k, n in zip(codes[i], counts[i].tolist())} == Counter(links)


def test_texts(both):
    check_chunk(both, texts() + ODD)


def test_forgetting_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_SEGMENTS", 50)
    for some in (texts()[:20], texts()[10:40], ODD + texts()[:5]):
        check_chunk(both, some)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Zé\n\t▁  .,'1日𝒳́<|>"), max_size=40), max_size=5))
def test_any_text(both, some):
    check_chunk(both, some)


def test_intervals():
    a, b, shared = alignment.overlaps(np.array([2, 5, 6]), np.array([1, 5, 6]))
    assert list(zip(a.tolist(), b.tolist(), shared.tolist())) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, True)]
    assert list(zip(*(x.tolist() for x in alignment.products(a, b, shared)))) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]


def test_corpus_counts(spark, both):
    table = rows()
    docs = spark.createDataFrame(table, SCHEMA).withColumnRenamed("size", "n_a").withColumnRenamed("doc", "codes")
    got = sorted((tuple(r) for r in alignment.aligned(docs, *both[0]).collect()), key=lambda r: (r[0] is None, r))
    each = [(r[0], *plain(both[1], r[1])) for r in table]
    count = Counter(x for *_, links in each for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = [(i, len(a), len(b), len(g), len(x), sum(count[y] == best[y[1]] for y in x), sum(count[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, x in each]
    assert got == sorted(want, key=lambda r: (r[0] is None, r))


def test_no_rows(spark, both):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), *both[0]).collect() == []
    assert sorted(tuple(r) for r in alignment.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *both[0]).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
