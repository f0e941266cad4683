"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good or bad on a document or abstain; most have evidence of one kind only.
Expectation-maximisation over the number of documents of each vote pattern (all documents are counted; patterns are
bounded by 3^labellers) estimates each labeller's accuracy where it votes and the share of good documents, without any
gold label.  The posteriors of at most ``sample``
documents (those with the smallest hash of their id) train a logistic scorer on hashed features, which then scores every
whole text.

Defined results: null and wordless texts are voted bad by the length labeller and score like any text without features.
Without documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import flat
from .quality_rules import STOP_WORDS

GOOD, BAD, ABSTAIN = 1, 0, 2
LABELLERS = ("length", "symbols", "capitals", "repeats", "windows", "common_words", "word_length", "neighbours")
DIMS = 1 << 16
_SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], np.uint32)


def _bad_from(value: np.ndarray, bad: float) -> np.ndarray:
    return np.where(value >= bad, BAD, ABSTAIN)


class Batch:
    """Measures, votes and hashed features of a batch of texts."""

    def __init__(self, texts: list[str]) -> None:
        w = flat.Words(texts)
        self.n = w.counts()
        self.keys = w.hashes()
        self.first = w.first
        doc = np.repeat(np.arange(len(texts)), self.n)
        size = np.maximum(self.n, 1)

        def share(flag: np.ndarray) -> np.ndarray:
            return np.bincount(doc, flag, minlength=len(texts))[: len(texts)] / size

        length = (w.end - w.begin).astype(np.float64)
        sums = np.concatenate(([0], np.cumsum(np.isin(w.cps, _SYMBOLS))))
        symbols = sums[w.end] - sums[w.begin]
        upper = np.concatenate(([0], np.cumsum((w.cps >= 65) & (w.cps <= 90))))
        letters = np.concatenate(([0], np.cumsum((w.cps > 64))))
        capital = (upper[w.end] - upper[w.begin]) > 0.6 * np.maximum(letters[w.end] - letters[w.begin], 1)
        common = np.isin(self.keys, _common())
        again = np.zeros(len(self.keys), bool)
        again[1:] = (self.keys[1:] == self.keys[:-1]) & (doc[1:] == doc[:-1])
        pair = flat.mix64(self.keys + flat.mix64(doc.astype(np.uint64)))
        _, once = np.unique(pair, return_index=True)
        distinct = np.bincount(doc[once], minlength=len(texts))[: len(texts)] / np.sqrt(size * np.maximum(np.log2(size), 1))
        five = flat.windows(pair, 5)
        inside = doc[: len(five)] == doc[4:] if len(five) else np.zeros(0, bool)
        _, back, count = np.unique(five, return_inverse=True, return_counts=True)
        repeated = np.bincount(doc[: len(five)], (count[back] > 1) & inside, minlength=len(texts))[: len(texts)] / size if len(five) else np.zeros(len(texts))
        self.measures = {
            "symbols": np.bincount(doc, symbols, minlength=len(texts))[: len(texts)] / size,
            "capitals": share(capital & (length > 1)),
            "neighbours": share(again),
            "windows": repeated,
            "common": share(common),
            "word_length": np.bincount(doc, length, minlength=len(texts))[: len(texts)] / size,
            "distinct": distinct,
        }
        m = self.measures
        votes = {
            "length": np.where(self.n < 5, BAD, ABSTAIN),
            "symbols": _bad_from(m["symbols"], 0.2),
            "capitals": _bad_from(m["capitals"], 0.3),
            "repeats": np.where(m["distinct"] < 0.6, BAD, ABSTAIN),
            "windows": _bad_from(m["windows"], 0.3),
            "common_words": np.where(m["common"] > 0.12, GOOD, np.where((m["common"] < 0.02) & (self.n > 20), BAD, ABSTAIN)),
            "word_length": np.where((m["word_length"] > 12) | (m["word_length"] < 2.5), BAD, ABSTAIN),
            "neighbours": _bad_from(m["neighbours"], 0.25),
        }
        self.pattern = sum(votes[name] * 3**i for i, name in enumerate(LABELLERS)).astype(np.int64)
        # features: words, word shapes, and bins of the measures, hashed to DIMS; values are log(1 + share * 100)
        tail = w.cps[np.maximum(w.end - 1, 0)].astype(np.uint64) if len(w.end) else np.zeros(0, np.uint64)
        tail = np.where(tail > 64, np.uint64(64), tail)
        shape = flat.mix64(tail * np.uint64(4) + capital.astype(np.uint64) * np.uint64(2) + again.astype(np.uint64) + np.uint64(1 << 40))
        bins = [flat.mix64(np.floor(np.clip(v, 0, 30) * 20).astype(np.uint64) + np.uint64((i + 2) << 41)) for i, v in enumerate(self.measures.values())]
        rows = np.concatenate([doc, doc, np.tile(np.arange(len(texts)), len(bins))])
        slots = np.concatenate([flat.mix64(self.keys), shape, *bins]) & np.uint64(DIMS - 1)
        value = np.concatenate([1 / size[doc], 1 / size[doc], np.full(len(texts) * len(bins), 0.25)])
        key, place = np.unique(rows << 16 | slots.astype(np.int64), return_inverse=True)
        self.row, self.slot = key >> 16, key & (DIMS - 1)
        self.value = np.log1p(100 * np.bincount(place, value)).astype(np.float32) if len(key) else np.zeros(0, np.float32)


_COMMON: list[np.ndarray] = []


def _common() -> np.ndarray:
    if not _COMMON:
        _COMMON.append(np.sort(flat.Words(sorted(set(STOP_WORDS))).hashes()))
    return _COMMON[0]


@dataclass
class LabelModel:
    prior: float
    accuracy: np.ndarray  # of each labeller, where it votes

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good of each pattern."""
        z = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for i, a in enumerate(self.accuracy):
            vote = (patterns // 3**i) % 3
            z += np.where(vote == GOOD, 1, np.where(vote == BAD, -1, 0)) * np.log(a / (1 - a))
        return 1 / (1 + np.exp(-z))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, pseudo: float = 10.0) -> LabelModel:
    """Labellers start 80 % accurate where they vote, and ``pseudo`` such votes stay in their estimate."""
    model = LabelModel(0.7, np.full(len(LABELLERS), 0.8))
    votes = [(patterns // 3**i) % 3 for i in range(len(LABELLERS))]
    for _ in range(rounds):
        good = model.posterior(patterns)
        prior = float(np.clip((good * counts).sum() / max(counts.sum(), 1), 0.01, 0.99))
        accuracy = np.empty(len(LABELLERS))
        for i, v in enumerate(votes):
            agreed = (np.where(v == GOOD, good, np.where(v == BAD, 1 - good, 0)) * counts).sum()
            accuracy[i] = (agreed + 0.8 * pseudo) / (counts[v != ABSTAIN].sum() + pseudo)
        accuracy = np.clip(accuracy, 0.55, 0.98)
        done = abs(prior - model.prior) < 1e-9 and np.abs(accuracy - model.accuracy).max() < 1e-9
        model = LabelModel(prior, accuracy)
        if done:
            break
    return model


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 40, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (and bias, last) of a logistic model by full-batch AdaGrad."""
    w, total = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-6)
    if not rows:
        return w
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    slot, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    for _ in range(rounds):
        z = np.bincount(row, w[slot] * value, minlength=len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(slot, error[row] * value, minlength=DIMS + 1) / len(rows) + decay * w
        g[-1] = error.mean()
        total += g * g
        w -= rate * g / np.sqrt(total)
    return w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000) -> tuple[LabelModel, np.ndarray]:
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for i, j in flat.chunks([len(t) for t in texts]):
                seen += np.bincount(Batch(texts[i:j]).pattern, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pattern", "n"])

    found = plain.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    model = expectation_maximisation(np.array([r.pattern for r in found], np.int64), np.array([r.n for r in found], np.float64))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in flat.chunks([len(t) for t in texts]):
                x = Batch(texts[i:j])
                at = np.searchsorted(x.row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x.pattern), pa.ListArray.from_arrays(pa.array(at), pa.array(x.slot.astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(x.value))], ["pattern", "slots", "values"])

    total = max(1, sum(r.n for r in found))
    bound = min((1 << 63) - 1, int(-(1 << 63) + min(1.0, 1.3 * sample / total) * ((1 << 64) - 1)))
    picked = plain.filter(F.coalesce(F.xxhash64("id") <= F.lit(bound), F.lit(False))).orderBy(F.xxhash64("id"), "id").limit(sample).select("text")
    rows = picked.mapInArrow(features, "pattern long, slots array<int>, values array<float>").collect()
    target = model.posterior(np.array([r.pattern for r in rows], np.int64)) if rows else np.zeros(0)
    weights = train_scorer([(np.array(r.slots, np.int64), np.array(r["values"], np.float32)) for r in rows], target)
    return model, weights.astype(np.float32)


def score(docs: DataFrame, model: LabelModel, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: better), posterior (of the labellers' votes alone)."""
    held = docs.sparkSession.sparkContext.broadcast((model, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, w = held.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in flat.chunks([len(t) for t in texts]):
                x = Batch(texts[i:j])
                z = np.bincount(x.row, w[x.slot] * x.value, minlength=j - i) + w[-1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(label.posterior(x.pattern))], ["id", "score", "posterior"])

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, "id long, score double, posterior double")
    return out.withColumnRenamed("id", id_col)
