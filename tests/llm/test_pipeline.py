from collections import Counter, defaultdict

import brute
import fixtures
import pyarrow as pa
import pytest

import corpus_pipeline
from quotegrid.llm import decontam, mixing, simhash, tokenstore, toxicity
from quotegrid.llm.entry import tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with the awkward rows of the fixtures and an extra column."""
    d = str(tmp_path_factory.mktemp("tables"))
    rows = fixtures.rows()
    rows += [(900 + i, f"some words {i} and scum {'idiot ' * (i % 3)} end " + " ".join(f"t{i}x{j}" for j in range(30)), "en", "s1", 1, 1, 1, 1, 1) for i in range(12)]
    rows += [(950, "before " + ITEM + " after", "en", "s2", 1, 1, 1, 1, 1), (951, ITEM.upper().replace("seventh", "sevent"), "en", "s2", 1, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 1 if "scum" in (r[1] or "") else 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


ITEM = "the first second third fourth fifth sixth seventh eighth ninth tenth words of an item that stands in a benchmark"


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / f"{k}"))
        out = spark.read.parquet(str(tmp_path / f"{k}"))
        after = [tuple(r) for r in out.collect()]
        if name != "token_store":
            assert out.columns == columns
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            scorer = toxicity.Scorer(model.terms, model.stems)
            want = [r for r in before if model.score(scorer.features(pa.array([r[1]], pa.string())))[0] < toxicity.SCORE_AT]
            assert Counter(after) == Counter(want) and not any("scum" in (r[1] or "") for r in after) and len(after) > 80
        if name == "simhash_dedup":
            groups = defaultdict(list)  # of texts whose 5-word shingle sets agree by 0.8 or more
            for r, g in zip(before, brute.set_groups([r[1] for r in before])):
                groups[g].append(r[0])
            assert Counter(r[0] for r in after) == Counter(min(g, key=lambda i: (i is None, i)) for g in groups.values())
            assert set(after) <= set(before)
        if name == "decontamination":
            assert Counter(after) == Counter(r for r in before if "fourth" not in (r[1] or "").lower())
        if name == "mixing":
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in before:
                sizes[r[3]] += len(brute.words(r[1]))
            for r in after:
                taken[r[3]] += len(brute.words(r[1]))
            order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
            want = dict(zip(order, mixing.capped_targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], 3)))
            assert all(abs(taken[s] - want[s]) <= 1024 for s in order)
            texts, times = defaultdict(list), Counter(r[0] for r in after)
            for r in before:
                texts[r[0]].append(brute.words(r[1]))
            assert all(n <= 3 * len(texts[i]) for i, n in times.items())
            for r in after:  # the words of a document, in order
                rest = [iter(own) for own in texts[r[0]]]
                assert any(all(w in it for w in brute.words(r[1])) for it in rest)
        if name == "token_store":
            assert sorted((r[2], r[3]) for r in after) == sorted((n, c) for _, _, n, c in brute.token_rows([(r[0], r[1]) for r in before], tokenizer_path()))
        docs, before = out, after


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "g h i j k l", "en", "t", 1), (None, "g h i j k l", "en", "t", 1), (None, "m n o p", None, None, None), (None, "m n o p", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(tuple(r)[:2] for r in simhash.one_of_each(df).collect()) == Counter([(1, rows[0][1]), (2, rows[2][1]), (None, "m n o p")])
    out = mixing.take(df, block=1).collect()
    assert sum(len(r.text.split()) for r in out) == pytest.approx(sum(len(r[1].split()) for r in rows), abs=3)
    assert mixing.take(df.limit(0)).collect() == [] and simhash.one_of_each(df.limit(0)).collect() == []
    assert decontam.without_leaks(df.limit(0), df.selectExpr("doc_id as item_id", "text")).collect() == []


def test_empty_tables(spark, folder, tmp_path):
    """Every stage, one after another, on tables without rows."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.collect() == []


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50
    assert tokenstore.write_store(spark.read.parquet(f"{folder}/documents.parquet").limit(0), tokenizer_path())
