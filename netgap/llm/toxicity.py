"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are lower-case words.  A uniform, bounded sample of labelled rows gives the examples; every term of every example is
indexed.  A term weighs log(1 + count) times its idf over all documents times its relevance: ``FLOOR`` plus what the z-score
of its log odds between the labels exceeds ``CHANCE``.  (By plain TF-IDF, neighbours share topic and language, and labels
hardly follow; the README has figures.)

Examples are laid out in blocks of neighbours.  Each term has a posting list of (example, weight).  Those of the ``HEAD``
commonest terms hold nearly every example and are kept as arrays, with the largest weight of each block; the others are
short and are summed at once, and the largest sum of each block is taken.  Both together bound the cosine of every
example of a block; blocks are read from the highest bound on, until no other can hold one of the k nearest, so the
result is exact.  Votes weighted by squared cosine, with the prior as one more vote, give
a share; a logistic curve, fitted to the shares which the examples get from each other, turns it into a probability.

Defined results: a text without any term of the examples (null and empty too) has no neighbours and scores the prior.
Ties in similarity go to the example that comes first in the index.  Rows that repeat an id are scored each for itself; an id
that repeats among the documents gives the example with the smallest text; among the labels, the largest label counts.
Without labelled rows the prior is 0.  Texts of any length are read whole; columns other than id, text and label are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import flat

WORD = re.compile(r"\w+")
BLOCK, HEAD, WAVE = 32, 128, 16
FLOOR, CHANCE = 0.1, 2.0


def terms_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Index:
    terms: dict[str, int]  # by falling number of examples
    gain: np.ndarray  # idf times relevance of each term
    prior: float
    ids: np.ndarray  # doc_id of each example
    toxic: np.ndarray
    head: np.ndarray  # examples (padded to whole blocks) x commonest terms: weights of unit vectors
    head_most: np.ndarray  # commonest terms x blocks: largest weight
    begin: np.ndarray  # where the list of each other term begins
    example: np.ndarray
    weight: np.ndarray
    k: int = 25
    prior_votes: float = 0.5
    curve: tuple[float, float] = (1.0, 0.0)  # slope and shift of the log odds

    def query(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights (unit length) of a text."""
        t = np.fromiter(counts.keys(), np.int64, len(counts))
        w = np.log1p(np.fromiter(counts.values(), np.float64, len(counts))) * self.gain[t]
        return t, (w / max(np.linalg.norm(w), 1e-12)).astype(np.float32)

    def search(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The exact k nearest examples with cosine above 0: positions and cosines, best first."""
        n, blocks = len(self.ids), self.head_most.shape[1]
        q = np.zeros(self.head.shape[1], np.float32)
        common = t < len(q)
        q[t[common]] = w[common]
        rare, wr = t[~common] - len(q), w[~common]
        tail = _sums(self.begin, self.example, self.weight, rare, wr, len(self.head))
        near = q @ self.head_most + tail.reshape(blocks, BLOCK).max(1, initial=0)
        order = np.argsort(-near, kind="stable")
        found, sims, least, at = [], [], 0.0, 0
        while at < blocks and near[order[at]] * 1.0001 > least:  # the bound and the cosine are rounded apart
            wave = order[at : at + WAVE]
            wave = wave[near[wave] * 1.0001 > least]
            rows = (wave[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            s = np.concatenate([self.head[b * BLOCK : (b + 1) * BLOCK] @ q for b in wave.tolist()]) + tail[rows]
            hit = np.flatnonzero((s > 0) & (rows < n) & (s >= least))
            found.append(rows[hit])
            sims.append(s[hit])
            at += WAVE
            if sum(map(len, sims)) >= k:
                least = float(np.partition(np.concatenate(sims), -k)[-k])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        p, s = np.concatenate(found), np.concatenate(sims)
        best = np.lexsort((p, -s))[:k]
        return p[best], s[best]


def _sums(begin: np.ndarray, place: np.ndarray, value: np.ndarray, t: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """For each place the sum of its values in the lists of terms t, times their weights w."""
    size = begin[t + 1] - begin[t]
    at = flat.ragged(begin[t], size)
    return np.bincount(place[at], weights=value[at] * np.repeat(w, size), minlength=n).astype(np.float32)


def relevance(p: np.ndarray, n: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """What a term tells about the label, from the examples of label 1 (p of n1) and 0 (n of n0) that hold it."""
    a, b, c, d = p + 0.5, n + 0.5, n1 - p + 0.5, n0 - n + 0.5
    z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return FLOOR + np.maximum(0.0, z - CHANCE)


@dataclass
class Examples:
    """Labelled texts: the terms of example i, and how often each stands in it, are at begin[i] to begin[i + 1]."""

    ids: np.ndarray
    toxic: np.ndarray
    begin: np.ndarray
    term: np.ndarray
    count: np.ndarray


def build(e: Examples, terms: list[str], df: np.ndarray, n_docs: int, prior: float) -> Index:
    """``terms`` by falling number of examples; ``df`` over ``n_docs``."""
    v, t, y, n1 = len(terms), e.term, e.toxic, int(e.toxic.sum())
    row = np.repeat(np.arange(len(y)), np.diff(e.begin))
    held = np.bincount(t, minlength=v).astype(np.float64)
    told = np.bincount(t, weights=y[row], minlength=v)
    gain = (np.log((1 + n_docs) / (1 + df)) + 0.1) * relevance(told, held - told, n1, len(y) - n1)
    w = np.log1p(e.count.astype(np.float64)) * gain[t]
    w /= np.maximum(np.sqrt(np.bincount(row, weights=w * w, minlength=len(y))), 1e-12)[row]
    # neighbours: examples with the same heaviest term
    top = np.full(len(y), -1, np.int64)
    by = np.lexsort((w, row))
    top[row[by]] = t[by]
    order = np.lexsort((e.ids, top))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = place[row]
    blocks, head = -(-len(y) // BLOCK), min(HEAD, v)
    dense = np.zeros((blocks * BLOCK, head), np.float32)
    on = t < head
    dense[row[on], t[on]] = w[on]
    t, row, w = t[~on] - head, row[~on], w[~on].astype(np.float32)
    by = np.lexsort((row, t))
    t, row, w = t[by], row[by], w[by]
    return Index(
        dict(zip(terms, range(v), strict=True)), gain, prior, e.ids[order], y[order], dense,
        dense.reshape(blocks, BLOCK, head).max(1).T.copy() if blocks else np.zeros((head, 0), np.float32),
        np.searchsorted(t, np.arange(v - head + 1)), row.astype(np.int32), w,
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 6000, k: int = 25, prior_votes: float = 0.5) -> Index:
    """``labels``: the rows that may be learnt from.  At most ``sample`` examples are used, those with the smallest hash of
    their id whatever their label; the prior is the share of label 1 in all of ``labels``."""
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    total = named.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    prior = (total.y or 0) / max(1, total.n)
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = spark.createDataFrame([(r.id, r.y) for r in named.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], "id long, y int")
    texts = plain.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(list(set(terms_of(t.as_py()))), pa.string())], ["term"])

    ranked = texts.mapInArrow(seen, "term string").groupBy("term").agg(F.count("*").alias("n")).toArrow()
    terms = ranked.sort_by([("n", "descending"), ("term", "ascending")])["term"].to_pylist()
    del ranked
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [count(t.as_py(), number.value) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], ["id", "y", "t", "c"])

    found = texts.mapInArrow(vectors, "id long, y int, t array<int>, c array<int>").toArrow().sort_by("id")
    t, c = (found[x].combine_chunks() for x in ("t", "c"))
    begin = np.append(0, np.cumsum(pc.list_value_length(t).to_numpy(zero_copy_only=False))).astype(np.int64)
    examples = Examples(found["id"].to_numpy(), found["y"].to_numpy().astype(np.int64), begin, t.flatten().to_numpy(), c.flatten().to_numpy())

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, held = np.zeros(len(number.value), np.int64), 0, Counter()

        def add() -> None:
            for w, c in held.items():
                if (k := number.value.get(w)) is not None:
                    df[k] += c
            held.clear()

        for b in batches:
            for i, j, part in flat.pieces(b.column(0)):
                n += j - i
                for t in part:
                    held.update(set(terms_of(t)))
                if len(held) > 200_000:
                    add()
        add()
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, on), pa.int32()), pa.array(np.append(n, df[on]), pa.int64())], ["t", "n"])

    counted = plain.select("text").mapInArrow(frequency, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    number.unpersist()
    df = np.zeros(len(terms) + 1)
    df[counted["t"].to_numpy()] = counted["n"].to_numpy()  # the last one (-1) is the number of documents
    index = build(examples, terms, df[:-1], int(df[-1]), prior)
    index.k, index.prior_votes = k, prior_votes
    calibrate(index, examples)
    return index


def count(text: str | None, number: dict[str, int]) -> dict[int, int]:
    return {k: c for w, c in Counter(terms_of(text)).items() if (k := number.get(w)) is not None}


def share(index: Index, p: np.ndarray, s: np.ndarray) -> float:
    """Share of label 1 in the votes of neighbours p with cosines s, and of the prior."""
    w = s.astype(np.float64) ** 2
    return (float((w * index.toxic[p]).sum()) + index.prior_votes * index.prior) / (float(w.sum()) + index.prior_votes)


def _log_odds(x: np.ndarray | float) -> np.ndarray:
    x = np.clip(x, 1e-4, 1 - 1e-4)
    return np.log(x / (1 - x))


def calibrate(index: Index, e: Examples) -> None:
    """Fits the curve to the shares of the examples, each without its own vote (Newton steps, slightly damped)."""
    x, y = [], []
    for i, label, a, b in zip(e.ids.tolist(), e.toxic.tolist(), e.begin[:-1].tolist(), e.begin[1:].tolist(), strict=True):
        if a < b:
            p, s = index.search(*index.query(dict(zip(e.term[a:b].tolist(), e.count[a:b].tolist(), strict=True))), index.k + 1)
            other = np.flatnonzero(index.ids[p] != i)[: index.k]
            x.append(share(index, p[other], s[other]))
            y.append(label)
    if not 0 < sum(y) < len(y):
        return
    x = np.stack([_log_odds(np.array(x)), np.ones(len(x))], 1)
    y, b = np.array(y), np.array([1.0, 0.0])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hold = np.eye(2)  # keeps the curve near the identity where examples are few
        b += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + hold, x.T @ (y - q) - hold @ (b - [1.0, 0.0]))
    index.curve = (max(0.05, float(b[0])), float(b[1]))


def vote(index: Index, found: dict[int, int]) -> tuple[float, list[int], list[float]]:
    """Score of a text, and the ids and cosines of its neighbours."""
    if not found or not len(index.ids):
        return index.prior, [], []
    p, s = index.search(*index.query(found), index.k)
    a, b = index.curve
    return float(1 / (1 + np.exp(-(a * _log_odds(share(index, p, s)) + b)))), index.ids[p].tolist(), s.astype(float).tolist()


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """id, score, evidence_ids and evidence_sims (the nearest examples), one row per row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        gc.freeze()  # the collector need not walk the index again and again
        for b in batches:
            for i, j, texts in flat.pieces(b.column(1)):
                out = [vote(x, count(t, x.terms)) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1][:evidence] for o in out], pa.list_(pa.int64())), pa.array([o[2][:evidence] for o in out], pa.list_(pa.float64()))], ["id", "score", "evidence_ids", "evidence_sims"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, score double, evidence_ids array<long>, evidence_sims array<double>")
    return out.withColumnRenamed("id", id_col)
