"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m characters with at most e = floor(rate * m) edits keeps at least m - q + 1 - q * e of the
item's q-grams, all within e diagonals of each other.  Shared q-grams are counted in overlapping bands of diagonals
(width 2e + 2, step e + 1); bands that reach the bound are verified by alignment of the item with that region alone.
Items too short for q characters take the largest q that leaves a bound of at least 1; those without an edit to spend and
under q characters are looked up by exact search.  Texts are compared in lower case with runs of white
space as one space.

The benchmark is the stated query set: it is taken in blocks of bounded size, and each block is compared with all rows.
Defined results: null or empty texts and items match nothing; repeated item ids are reported once a document, with the
fewest edits and then the first end; rows that repeat a document id report all their items under it; null document ids
are one document; texts and items of any length are taken whole; extra columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import align, flat

Q, RATE = 8, 0.1
#: Characters of benchmark text held at once.
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def gram(size: int, q: int, rate: float) -> int:
    """The largest q-gram size up to ``q`` for which an item of ``size`` characters has a bound of at least 1."""
    edits = int(rate * size)
    return q if not edits else max(1, min(q, size // (edits + 1)))


@dataclass
class Block:
    ids: list[int]
    texts: list[str]
    q: int
    rate: float
    keys: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)  # first posting of each key
    item: np.ndarray = field(init=False)
    pos: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.floor(self.rate * self.size).astype(np.int64)
        self.bound = self.size - self.q + 1 - self.q * self.edits
        self.short = [i for i in range(len(self.texts)) if self.bound[i] < 1 and self.texts[i]]
        cps, starts = flat.code_points(self.texts)
        count = np.where(self.bound >= 1, np.maximum(self.size - self.q + 1, 0), 0)
        where = flat.ragged(starts[:-1], count)
        grams = flat.windows(cps.astype(np.uint64), self.q).view(np.int64)[where] & 0x7FFFFFFFFFFFFFFF if len(where) else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(self.texts)), count)
        order = np.argsort(grams, kind="stable")
        self.keys, begin = np.unique(grams[order], return_index=True)
        self.at = np.append(begin, len(order))
        self.item, self.pos = item[order], (where - starts[item])[order] if len(where) else where
        self.index = None

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, end) of every occurrence within the budget; texts and items are normal."""
        if self.index is None:
            self.index = flat.HashIndex(self.keys)
        out = [(k, i, 0, t.find(self.texts[i]) + len(self.texts[i])) for i in self.short for k, t in enumerate(texts) if self.texts[i] in t]
        cps, starts = flat.code_points(texts)
        if len(cps) < self.q or not len(self.keys):
            return out
        found = self.index.find(flat.windows(cps.astype(np.uint64), self.q).view(np.int64) & 0x7FFFFFFFFFFFFFFF)
        where = np.flatnonzero(found >= 0)
        n = self.at[found[where] + 1] - self.at[found[where]]
        post = flat.ragged(self.at[found[where]], n)
        item, diagonal = self.item[post], np.repeat(where, n) - self.pos[post] + len(cps)
        step = self.edits[item] + 1
        band = diagonal // step
        key = np.concatenate((item << 40 | band, item << 40 | (band - 1)))  # band b spans diagonals b*step .. (b+2)*step - 1
        key, count = np.unique(key, return_counts=True)
        item = key >> 40
        good = count >= self.bound[item]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i, b in zip(item[good].tolist(), (key[good] & ((1 << 40) - 1)).tolist(), strict=True):
            e = int(self.edits[i])
            low = b * (e + 1) - len(cps)
            middle = min(max(low + e + 1, 0), len(cps) - 1)
            k = int(np.searchsorted(starts, middle, "right")) - 1
            for k in {k, max(0, int(np.searchsorted(starts, max(0, low), "right")) - 1), min(len(texts) - 1, int(np.searchsorted(starts, max(0, low + 2 * e + 1), "right")) - 1)}:
                begin = max(0, low - e - int(starts[k]))
                end = low + 2 * e + 2 + int(self.size[i]) + e - int(starts[k])
                if end <= 0:
                    continue
                hit = align.find_approximate(self.texts[i], texts[k][begin:end], e)
                if hit and ((k, i) not in best or hit[0] < best[k, i][0]):
                    best[k, i] = (hit[0], begin + hit[1])
        return out + [(k, i, e, z) for (k, i), (e, z) in best.items()]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """One row for each document and benchmark item in it: id, item_id, edits, end (offset in the normal text)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter(F.col("item").isNotNull() & (F.length("text") > 0)).distinct()
    total = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n_blocks = 1 + total // BLOCK_CHARS
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    out = None
    for k in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).orderBy("item", "text").collect()
        texts = [normal(r.text) for r in rows]
        sizes = [gram(len(t), q, rate) for t in texts]
        held = spark.sparkContext.broadcast([Block([r.item for r, z in zip(rows, sizes, strict=True) if z == g], [t for t, z in zip(texts, sizes, strict=True) if z == g], g, rate) for g in sorted(set(sizes))])

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, texts in flat.pieces(b.column("text")):
                    texts = [normal(t) for t in texts]
                    ids = b.column("id").slice(i, j - i)
                    for x in held.value:
                        if not (found := x.find(texts)):
                            continue
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([f[0] for f in found])), pa.array([x.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())], ["id", "item_id", "edits", "end"])

        part = plain.mapInArrow(work, "id long, item_id long, edits int, end int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(F.col("id").alias(id_col), "item_id").agg(F.min(F.struct("edits", "end")).alias("m")).select(id_col, "item_id", "m.edits", "m.end")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """id, n_items, item_ids (ascending) of the documents that hold benchmark items."""
    found = matches(docs, benchmark, id_col, **options)
    return found.groupBy(id_col).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("edits").alias("least_edits"))
