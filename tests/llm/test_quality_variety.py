"""Variety is counted over the whole text."""

from quotegrid.llm import quality


def vote(rows, name):
    k = [r[0] for r in quality.RULES].index(name)
    return [r.v // 3**k % 3 for r in rows]


def test_variety_beyond_the_first_block(spark):
    varied = [f"w{i}" for i in range(2000)]
    texts = [" ".join(varied[:50] + ["a", "b", "c"] * 900), " ".join(["a"] * 50 + varied), " ".join(varied[:30]), " ".join(varied[:51]), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = quality.statistics(df).withColumn("v", quality.votes()).orderBy("doc_id").collect()
    assert [r.n_distinct for r in rows] == [50 + 54 * 3, 1 + 2000, 30, 51, 0, 0]
    assert vote(rows, "distinct_words") == [2, 1, 1, 1, 0, 0]
