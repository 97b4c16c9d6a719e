"""Quality by weak supervision.

Rules over text statistics vote good (1), bad (2) or abstain (0). A document's
votes are one number, so the corpus comes down to counts of vote patterns
(3 ** rules at most), over which expectation-maximisation estimates the share of
good documents and each rule's accuracy on good and on bad ones. The posterior
that a document is good, given its votes, takes the place of a filter that all
rules must pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mix64, small_batches, text_chunks, window_hashes, written

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Words in a block; n_distinct is the sum of the blocks' distinct words.
BLOCK = 50
#: name, statistic, good if at most / at least, bad if above / below ("<" means that small values are good).
RULES = (
    ("symbols", "n_symbols / n_words", "<", 0.02, 0.10),
    ("capitals", "n_upper / greatest(n_letters, 1)", "<", 0.20, 0.50),
    ("exclamation", "n_exclaim / n_words", "<", 0.02, 0.15),
    ("repeated_words", "n_repeat_words / n_words", "<", 0.08, 0.20),
    ("repeated_lines", "n_dup_lines / n_lines", "<", 0.10, 0.30),
    ("plain_words", "n_plain / n_words", ">", 0.85, 0.65),
    ("distinct_words", "n_distinct / n_words", ">", 0.40, 0.20),
)
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_exclaim long, n_plain long, n_distinct long"
KEEP_AT = 0.5


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_words(words: Words, width: int) -> np.ndarray:
    """For each text, the words in windows of ``width`` that the text has twice or more."""
    out = np.zeros(len(words.n), np.int64)
    codes, text = words.codes, words.text_of_word()
    if len(codes) < width:
        return out
    starts = np.flatnonzero(text[: len(codes) - width + 1] == text[width - 1 :])
    key = mix64(window_hashes(mix64(codes.astype(U64) + U64(1)), width)[starts] + mix64(text[starts].astype(U64) + U64(7)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + width, -1)
    return _sums(np.cumsum(edge[:-1]) > 0, words.offsets)


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its lines with a word, and those of them that equal an earlier one."""
    data, bounds = words.data, words.bounds
    ends = np.flatnonzero(data == 10)
    starts, stops = np.sort(np.concatenate((bounds[:-1], ends + 1))), np.sort(np.concatenate((ends, bounds[1:])))
    per_text = 1 + np.searchsorted(ends, bounds[1:]) - np.searchsorted(ends, bounds[:-1])
    text = np.repeat(np.arange(len(per_text)), per_text)
    real = np.searchsorted(words.starts, stops) > np.searchsorted(words.starts, starts)
    lines = np.bincount(text[real], minlength=len(per_text))
    if not real.any():
        return lines, np.zeros(len(per_text), np.int64)
    cuts = np.empty(2 * len(starts), np.int32)
    cuts[0::2], cuts[1::2] = starts, stops
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    codes = np.asarray(pieces.dictionary_encode().indices)[0::2].astype(np.int64)
    pairs = np.unique(text[real] * (int(codes.max()) + 1) + codes[real])
    return lines, lines - np.bincount(pairs // (int(codes.max()) + 1), minlength=len(per_text))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch, "text"):
            words = Words(chunk.column("text"))
            names = words.unique.cast(pa.string())
            number = lambda x: np.asarray(x.fill_null(0)).astype(np.int64)
            each = {
                "word_chars": number(pc.utf8_length(names)),
                "n_symbols": number(pc.count_substring_regex(names, pattern=SYMBOLS)),
                "n_upper": number(pc.count_substring_regex(names, pattern=r"\p{Lu}")),
                "n_letters": number(pc.count_substring_regex(names, pattern=r"\p{L}")),
                "n_exclaim": number(pc.count_substring(names, pattern="!")),
                "n_plain": number(pc.match_substring_regex(names, pattern=r"^[\p{L}\p{M}'-]+[.,;:!?]?$").cast(pa.int8())),
            }
            sums = {k: _sums(v[words.codes], words.offsets) if len(words.codes) else np.zeros(len(words.n), np.int64) for k, v in each.items()}
            text = words.text_of_word()
            block = (np.arange(len(text)) - np.repeat(words.offsets[:-1], words.n)) // BLOCK  # variety falls with length: it is counted in blocks of the same length
            block += np.repeat(np.cumsum((words.n + BLOCK - 1) // BLOCK) - (words.n + BLOCK - 1) // BLOCK, words.n)
            seen = np.unique(block * (len(names) + 1) + words.codes) // (len(names) + 1)
            distinct = np.repeat(np.arange(len(words.n)), (words.n + BLOCK - 1) // BLOCK)[seen]
            lines, dup = _lines(words)
            out = {"doc_id": chunk.column("doc_id"), "n_words": words.n, **sums, "n_lines": lines, "n_dup_lines": dup, "n_repeat_words": _repeated_words(words, WINDOW), "n_distinct": np.bincount(distinct, minlength=len(words.n))}
            names_out = [x.split()[0] for x in STATS.split(", ")]
            yield pa.RecordBatch.from_arrays([out[k] if k == "doc_id" else pa.array(out[k].astype(np.int64)) for k in names_out], names_out)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over each whole text; a null text has none."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_stats, STATS)


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def votes(rules=RULES) -> Column:
    """All rules' votes as digits of one number to the base 3; a text without words abstains but for its length."""
    digits = []
    for k, (_, stat, way, good, bad) in enumerate(rules):
        value = F.expr(f"case when n_words > 0 then ({stat}) * 1D end") if stat != "n_words" else F.expr("n_words * 1D")
        one = F.when(value <= good, 1).when(value > bad, 2) if way == "<" else F.when(value >= good, 1).when(value < bad, 2)
        digits.append(F.coalesce(one, F.lit(0)) * 3**k)
    return sum(digits[1:], digits[0]).cast("int")


#: The prior: a rule speaks against a good document this rarely, and against a bad one, which may have another fault, this often.
FALSE_ALARM, RECALL, PRIOR_SHARE = 0.01, 0.3, 0.002


def fit(patterns: list[tuple[int, int]], n_rules: int, rounds: int = 300) -> tuple[float, np.ndarray, np.ndarray]:
    """From (votes, count): the share of good documents, and each rule's accuracy
    on good and on bad ones (where it votes). Rules name different faults, so
    their accuracy on bad documents may be low. The priors weigh as much as
    PRIOR_SHARE of the corpus: they decide where the corpus says nothing, as of a
    rule that never votes, and else the counts do."""
    if not patterns:
        return 0.5, np.full(n_rules, 1 - FALSE_ALARM), np.full(n_rules, RECALL)
    p, n = np.array([x for x, _ in patterns]), np.array([c for _, c in patterns], float)
    vote = p[:, None] // 3 ** np.arange(n_rules) % 3
    share, good, bad = 0.9, np.full(n_rules, 1 - FALSE_ALARM), np.full(n_rules, RECALL)
    weight = max(2.0, PRIOR_SHARE * n.sum())
    for _ in range(rounds):
        post = posterior(vote, share, good, bad)
        yes, no = n * post, n * (1 - post)
        new = (
            (yes.sum() + 9) / (n.sum() + 10),
            np.array([(yes[v == 1].sum() + (1 - FALSE_ALARM) * weight) / (yes[v > 0].sum() + weight) for v in vote.T]),
            np.array([(no[v == 2].sum() + RECALL * weight) / (no[v > 0].sum() + weight) for v in vote.T]),
        )
        moved = max(abs(new[0] - share), float(np.abs(new[1] - good).max()), float(np.abs(new[2] - bad).max()))
        share, good, bad = new[0], np.clip(new[1], 0.55, 0.9999), np.clip(new[2], 0.001, 0.9999)
        if moved < 1e-7:
            break
    return share, good, bad


def posterior(vote: np.ndarray, share: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The probability of good for rows of votes."""
    like = lambda yes: np.where(vote == 1, np.log(yes), np.where(vote == 2, np.log1p(-yes), 0.0)).sum(axis=1)
    odds = math.log(share) - math.log1p(-share) + like(good) - like(1 - bad)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def grade(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES, keep_at: float = KEEP_AT) -> DataFrame:
    """A row for each row of ``docs``: its statistics, base_failed, votes,
    probability (of good), kept.

    A null text counts as one without words: base_failed. A very long text is
    counted whole. A probability of just ``keep_at`` keeps. Repeated rows are
    graded alike. An empty table gives an empty result; other columns aren't
    read.
    """
    spark = docs.sparkSession
    stats = written(statistics(docs, id_col=id_col, text_col=text_col).withColumns({"base_failed": base_failed(), "votes": votes(rules)}))
    patterns = [(r[0], r[1]) for r in stats.groupBy("votes").count().collect()]  # 3 ** rules at most
    share, good, bad = fit(patterns, len(rules))
    vote = np.array([p for p, _ in patterns], np.int64).reshape(-1, 1) // 3 ** np.arange(len(rules)) % 3
    post = spark.createDataFrame([(int(p), float(x)) for (p, _), x in zip(patterns, posterior(vote, share, good, bad))], "votes int, probability double")
    return stats.join(F.broadcast(post), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_at))
