"""Toxicity by a misspelling-tolerant lexicon and its context.

The lexicon is learned from labelled rows: whole words and word beginnings that
mark toxic documents, chosen one after another by the toxic documents that they
add. It is a trie; a Levenshtein automaton of a text's word is run over it, and
branches are left where no state of the automaton survives, so a misspelled term
is found at the price of its own neighbourhood. A window of words around each
hit tells quotation (quotation marks, words of reporting) from abuse (address in
the second person). A logistic regression over the hits' sums gives the score.

Each distinct word of a chunk is looked up once; a regular expression made from
the terms' pieces (an edit leaves one of them in place) names those worth it.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, small_batches, text_chunks

#: Labelled rows that a model is fitted on, at most: those that come first by a hash of their id.
SAMPLE_ROWS = 8000
SCORE_AT = 0.3
EDGE = ".,;:!?\"'()[]{}<>|*$%&#-_“”‘’«»„…"
STEM_LENGTHS = range(4, 9)
CONTEXT = 6
# Words that report speech, and words of address.
REPORTING = frozenset("said says quote quoted quotes called term word words phrase means meaning defined definition example sagte zitat wort heißt dit cité mot dijo cita palabra".split())
ADDRESS = frozenset("you your yours u ur du dein deine dich tu toi ton te ti tú eres vous".split())
QUOTES = frozenset("\"“”„«»")


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LevenshteinAutomaton:
    """The automaton of all strings within k edits of a word. A state is the set
    of (place, edits) pairs, as the least edits for each place; states and steps
    are made when first needed and kept."""

    def __init__(self, word: str, k: int):
        self.word, self.k, self.steps = word, k, {}

    def start(self) -> tuple:
        return tuple((i, i) for i in range(min(self.k, len(self.word)) + 1))

    def step(self, state: tuple, c: str) -> tuple:
        key = (state, c if c in self.word else None)
        if key not in self.steps:
            best: dict[int, int] = {}
            for i, e in state:
                for j, f in ((i, e + 1), (i + 1, e + 1), (i + 1, e if i < len(self.word) and self.word[i] == c else e + 1)):
                    if j <= len(self.word) and f <= self.k and f < best.get(j, self.k + 1):
                        best[j] = f
            for i in sorted(best):  # letters of the word left out
                for j in range(i + 1, min(len(self.word), i + self.k - best[i]) + 1):
                    if best[i] + j - i < best.get(j, self.k + 1):
                        best[j] = best[i] + j - i
            self.steps[key] = tuple(sorted(best.items()))
        return self.steps[key]

    def accepts(self, state: tuple) -> int | None:
        """The edits with which the state accepts, or None."""
        n = len(self.word)
        found = [e + n - i for i, e in state if e + n - i <= self.k]
        return min(found, default=None)


class Lexicon:
    """Terms with weights in a trie; beginnings stand for all words that begin so."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.terms, self.stems = terms, stems
        self.trie: dict = {}
        for t in terms:
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        self.most = max((edits_for(t) for t in terms), default=0)
        self.filter = self._filter()

    def _filter(self) -> str | None:
        """A pattern that fits every word that a term or beginning can match."""
        some = [f"^{re.escape(s)}" for s in self.stems]
        for t in self.terms:
            k = edits_for(t)
            n = [round(i * len(t) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(n, n[1:]):
                before, after = a, len(t) - b
                gap = lambda m: f".{{{max(0, m - k)},{m + k}}}" if m else ""  # noqa: B023, E731
                some.append(f"^{gap(before)}{re.escape(t[a:b])}{gap(after)}$")
        return "|".join(some) if some else None

    def match(self, word: str) -> tuple[float, int] | None:
        """The weight and the edits of the best term for a word: fewest edits, then largest weight."""
        best: tuple[int, float] | None = None
        for n in range(1, len(word) + 1):
            if (w := self.stems.get(word[:n])) is not None and (best is None or w > -best[1]):
                best = (0, -w)
        automaton = LevenshteinAutomaton(word, self.most)
        stack = [(self.trie, automaton.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    e = automaton.accepts(state)
                    if e is not None and e <= edits_for(child):
                        best = min(best or (99, 0.0), (e, -self.terms[child]))
                elif after := automaton.step(state, c):
                    stack.append((child, after))
        return None if best is None else (-best[1], best[0])


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: Sequence[float] = (-2.0, 0.0, 0.0, 0.0, 0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(x)), x)) @ np.array(self.weights), -30, 30)))


def plain(names: pa.Array) -> pa.Array:
    """Words in lower case without what stands around them."""
    return pc.utf8_trim(pc.utf8_lower(names.cast(pa.string())), characters=EDGE)


def context_score(around: Sequence[str], at: int) -> float:
    """1 for a hit without a sign of quotation, more with an address, less where
    quotation marks enclose it or a word of reporting is near."""
    hit = around[at]
    enclosed = hit[:1] in QUOTES or hit[-1:] in QUOTES or (sum(c in QUOTES for w in around[:at] for c in w) % 2 == 1 and any(c in QUOTES for w in around[at + 1 :] for c in w))
    near = {w.lower().strip(EDGE) for i, w in enumerate(around) if i != at}
    score = 1.0
    if enclosed:
        score *= 0.3
    if near & REPORTING:
        score *= 0.5
    if near & ADDRESS:
        score *= 1.5
    return score


class Scorer:
    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.lexicon, self.known = Lexicon(terms, stems), {}

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text: heaviest exact hit in context, log of hits' sum, and logs
        of misspelled hits, of quoted hits, and of hits beyond the first."""
        words = Words(texts)
        out = np.zeros((len(texts), 5))
        if not self.lexicon.filter or not len(words.codes):
            return out
        names = plain(words.unique)
        maybe = np.flatnonzero(np.asarray(pc.match_substring_regex(names, pattern=self.lexicon.filter).fill_null(False)))
        found: dict[int, tuple[float, int]] = {}
        for i, name in zip(maybe.tolist(), names.take(pa.array(maybe)).to_pylist()):
            if name not in self.known:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[name] = self.lexicon.match(name)
            if self.known[name] is not None:
                found[i] = self.known[name]
        if not found:
            return out
        mark = np.zeros(len(names), bool)
        mark[list(found)] = True
        at = np.flatnonzero(mark[words.codes])
        text = np.searchsorted(words.offsets, at, side="right") - 1
        sums = np.zeros((len(texts), 5))
        for place, t in zip(at.tolist(), text.tolist()):
            lo, hi = max(int(words.offsets[t]), place - CONTEXT), min(int(words.offsets[t + 1]), place + CONTEXT + 1)
            around = [words.data[words.starts[i] : words.ends[i]].tobytes().decode() for i in range(lo, hi)]
            c = context_score(around, place - lo)
            weight, edits = found[int(words.codes[place])]
            if edits:
                sums[t, 2] += c
            else:
                sums[t, 0] = max(sums[t, 0], weight * min(c, 1.0))
                sums[t, 1] += weight * c
                sums[t, 4] += c
            if c < 0.6:
                sums[t, 3] += 1
        sums[:, 4] = np.maximum(sums[:, 4] - 1, 0)
        out[:, 0], out[:, 1:] = sums[:, 0] / 5, np.log1p(sums[:, 1:])
        return out


def learn_lexicon(texts: Sequence[str], toxic: Sequence[int], least: int = 4, most: int = 400, once: int = 8, odds: float = 2.5) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and beginnings that stand in toxic documents far more often
    (log odds of occurrences, ``once`` a document at most), one after another by
    the toxic documents that each adds to those found before. Equal texts count
    once. No more than ``most`` terms and beginnings are chosen so, which bounds
    what every worker holds; the frequent words after them are few by their own condition."""

    def terms_of(text: str) -> Counter[str]:
        own: Counter[str] = Counter()
        for w, n in Counter(w.lower().strip(EDGE) for w in text.split()).items():
            if len(w) >= 3:
                own[w] += n
                for k in STEM_LENGTHS:
                    if len(w) > k:
                        own[w[:k] + "*"] += n
        return own

    distinct = dict(zip(texts, toxic))
    bad = [t for t, y in distinct.items() if y]
    n_toxic, n_clean = len(bad), len(distinct) - len(bad)
    if not n_toxic or not n_clean:
        return {}, {}
    holders: dict[str, list[int]] = {}
    seen, clean = Counter(), Counter()
    for i, text in enumerate(bad):
        for t, n in terms_of(text).items():
            holders.setdefault(t, []).append(i)
            seen[t] += min(n, once)
    holders = {t: h for t, h in holders.items() if len(h) >= least}
    for text, y in distinct.items():  # one document's terms at a time
        if not y:
            for t, n in terms_of(text).items():
                if t in holders:
                    clean[t] += min(n, once)
    weight = {t: math.log((seen[t] + 0.5) / (n_toxic + 1)) - math.log((clean[t] + 0.5) / (n_clean + 1)) for t in holders}
    good = {t for t in holders if weight[t] >= odds}
    left, terms, stems = set(range(n_toxic)), {}, {}
    while good and len(terms) + len(stems) < most:
        gain = {t: sum(i in left for i in holders[t]) for t in good}
        best = max(good, key=lambda t: (gain[t] * min(weight[t], 5), weight[t], not t.endswith("*"), t))
        if gain[best] < least:
            break
        (stems if best.endswith("*") else terms)[best.rstrip("*")] = weight[best]
        left -= set(holders[best])
        good = {t for t in good if t != best and gain[t] >= least}
    for t, w in weight.items():  # frequent words that mark toxic documents by themselves, though others of these documents did before
        if not t.endswith("*") and len(holders[t]) >= 4 * least and w >= odds + 1.5 and not any(t.startswith(s) for s in stems):
            terms.setdefault(t, w)
    return terms, stems


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton steps; the intercept is free of the ridge."""
    a = np.column_stack((np.ones(len(x)), x))
    b, pull = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pull, a.T @ (y - p) - pull @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def fitted(rows: pa.Table) -> Model:
    """A model from labelled rows (doc_id, text, y)."""
    if not rows.num_rows:
        return Model()
    order = np.lexsort((np.asarray(pc.binary_length(rows.column("text"))), np.asarray(rows.column("doc_id"))))
    rows = rows.take(pa.array(order))
    text, y = rows.column("text").to_pylist(), np.asarray(rows.column("y")).astype(float)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(weights=(math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0, 0.0))
    terms, stems = learn_lexicon(text, y.astype(int).tolist())
    scorer, x = Scorer(terms, stems), []
    for batch in rows.to_batches():
        for chunk in text_chunks(batch, "text"):
            x.append(scorer.features(chunk.column("text")))
    return Model(terms, stems, regression(np.concatenate(x), y))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(pa.Table.from_batches(held)))], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``sample_rows`` labelled rows at most. Only labels whose
    crc32(id as text) mod 4 isn't 2 are used; the others are for tests. Rows
    without an id, label or text are left out; of rows that share an id the one
    with the smallest text hash is taken, so no more than ``sample_rows`` texts come
    to the task that fits the model, and none to the driver, which gets the terms
    and weights alone. Without labels of both kinds the model scores all texts alike."""
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null and crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg(F.max("y").alias("y"))
    some = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    one = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    small_batches(docs.sparkSession)
    found = one.select("doc_id", "text", "y").coalesce(1).mapInArrow(_fit, "model binary").first()  # ``sample_rows`` labels, so as many documents
    return pickle.loads(found["model"]) if found else Model()


def _scores(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.terms, model.stems)
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                score = model.score(scorer.features(chunk.column("text")))
                yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], pa.array(score)], [*chunk.schema.names[:-1], "score"])

    return rows


def scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; a null text is scored as an empty
    one, which has no hits; a very long one is scored whole. Of terms that match a
    word alike the heaviest counts. Repeated rows are scored alike; an empty table
    gives an empty result; other columns aren't read."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scores(model), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", score_at: float = SCORE_AT) -> DataFrame:
    """The rows of ``docs``, whole, whose text scores below ``score_at``: one that
    scores just that goes. Null and empty texts have the score of a text without
    hits; repeated rows stay or go together; an empty table stays empty. Other
    columns, whatever their names, are handed on."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.terms, model.stems)
        for batch in batches:
            for chunk in text_chunks(batch, text_col):
                score = model.score(scorer.features(chunk.column(text_col)))
                yield chunk.filter(pa.array(score < score_at))

    return docs.mapInArrow(rows, docs.schema)
