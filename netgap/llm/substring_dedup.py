"""Substring de-duplication by seed and extend.

A window is ``WINDOW`` neighbouring words ``[^\\x20\\x09-\\x0D]+`` of one document.  A word is removed if a window covers
it whose word sequence also starts in a document with a smaller id.

1. Exact copies: a document whose whole text also stands under a smaller id loses all its windows at once and is not
   extended.
2. Seeds: anchors of ``SEED`` words are winnowed so that every window holds one, its pick, which its words alone decide.
   Equal windows therefore have equal picks.  Only anchors that occur in two documents go on.
3. Extension: each shared anchor is extended both ways to the windows whose pick it is.  Windows are keyed by 96 bits
   of hash; windows that also stand under a smaller id are repeats.
4. The repeated windows of a document merge into maximal spans, which are cut out.

Anchors and windows are sorted once, by range of (key, id): a passage in a third of all documents is dealt over as many
tasks as its size asks for, and each task walks its rows in order.  What two tasks have of one key meets through the
last row of each.

Defined results: null text has no words; rows with a null id are kept whole and are nobody's source; rows that repeat an
id never remove each other's words, and each is judged against the other ids; texts of any length are taken whole; of
equal windows the smallest id keeps its words; extra columns are not read but for ``carry``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import flat, storage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW, SEED = 13, 8


def sliding(op: np.ufunc, a: np.ndarray, size: int) -> np.ndarray:
    """``op`` over each run of ``size`` neighbours, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        a = op(a[: len(a) - step], a[step:])
        have += step
    return a


def picks(hashes: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed keys at each word, the smallest seed key of the window that begins at each word, and whether that window
    lies in one text."""
    keys = flat.windows(hashes, seed) | np.uint64(1)
    least = sliding(np.minimum, keys, window - seed + 1)
    inside = np.zeros(len(least), bool)
    inside[flat.ragged(first[:-1], np.maximum(np.diff(first) - window + 1, 0))] = True
    return keys, least, inside


def winnow(hashes: np.ndarray, first: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Positions of the anchors among the words of all texts: the smallest seeds of each window, all of them on ties."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    wide = window - seed + 1
    keys, least, inside = picks(hashes, first, window, seed)
    least[~inside] = 0
    padded = np.zeros(len(keys) + wide - 1, np.uint64)
    padded[wide - 1 : wide - 1 + len(least)] = least
    return np.flatnonzero(sliding(np.maximum, padded, wide) == keys)


def anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Anchors of rows (id, tag, text): key, id, and place (tag and word)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b.column("id").to_numpy(), b.column("tag").to_numpy()
            for i, j, texts in flat.pieces(b.column("text")):
                w = flat.Words(texts)
                h = w.hashes()
                at = winnow(h, w.first, window, seed)
                doc = np.searchsorted(w.first, at, "right") - 1
                keys = flat.windows(h, seed)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[i:j][doc]), pa.array(tags[i:j][doc] << 32 | (at - w.first[doc]))], ["key", "id", "place"])

    return docs.select("id", "tag", "text").mapInArrow(work, "key long, id long, place long")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """id and place of the rows (key, id, place) whose key stands under two ids, and those at the ends of a range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key, while it has stood under one id
        known = None  # the last key, once it has stood under two ids, or began the range
        for b in batches:
            if not b.num_rows:
                continue
            if held and all(held[0].column(c)[0] == b.column(c)[b.num_rows - 1] for c in ("key", "id")):  # and so all rows of b
                held.append(b)
                continue
            t = pa.Table.from_batches([*held, b])
            key, ids = t["key"].to_numpy(), t["id"].to_numpy()
            if not held and known is None:
                known = key[0]
            begin = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            many = np.zeros(len(key), bool)
            many[1:] = (key[1:] == key[:-1]) & (ids[1:] != ids[:-1])
            good = np.logical_or.reduceat(many, begin)
            good |= key[begin] == known
            size = np.diff(np.append(begin, len(key)))
            held = [] if good[-1] else t.slice(int(begin[-1])).combine_chunks().to_batches()
            known = key[-1] if good[-1] else key[0] if known is None else known
            keep = t.filter(pa.array(np.repeat(good, size))).select(["id", "place"])
            yield from keep.combine_chunks().to_batches()
        yield from (h.select(["id", "place"]) for h in held)

    return rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(work, "id long, place long")


def extended(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Windows of rows (id, tag, text, at) whose pick is an anchor at one of the words ``at``: two hashes, id, place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags, places = b.column("id").to_numpy(), b.column("tag").to_numpy(), b.column("at")
            for i, j, texts in flat.pieces(b.column("text")):
                w = flat.Words(texts)
                h = w.hashes()
                if len(h) < window:
                    continue
                keys, least, inside = picks(h, w.first, window, seed)
                marked = np.full(len(keys), 0xFFFFFFFFFFFFFFFF, np.uint64)
                for k in range(j - i):
                    p = w.first[k] + places[i + k].values.to_numpy()
                    marked[p] = keys[p]
                at = np.flatnonzero(inside & (sliding(np.minimum, marked, window - seed + 1) == least))
                doc = np.searchsorted(w.first, at, "right") - 1
                w1 = flat.windows(h, window)[at].view(np.int64)
                w2 = flat.windows(w.hashes(1), window, 1)[at].view(np.int64).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(ids[i:j][doc]), pa.array(tags[i:j][doc] << 32 | (at - w.first[doc]))], ["w1", "w2", "id", "place"])

    return docs.select("id", "tag", "text", "at").mapInArrow(work, "w1 long, w2 int, id long, place long")


#: Kinds of rows of ``repeated``: a repeat; a row of a range's first key and id, which an earlier range may repeat; the last row.
REPEAT, OPEN, LAST = 0, 1, 2


def repeated(rows: DataFrame) -> DataFrame:
    """id and place of the rows (w1, w2, id, place) whose key also stands under a smaller id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first = None  # the key and smallest id of the rows before; the key and id that begin the range
        for b in batches:
            if not b.num_rows:
                continue
            w1, w2, ids = (b.column(c).to_numpy() for c in ("w1", "w2", "id"))
            new = np.append(at is None or (w1[0], w2[0]) != at[:2], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            least = ids[begin]
            if not new[0]:
                least = np.where(begin < 0, at[2], least)
            if first is None:
                first = (w1[0], w2[0], ids[0])
            kind = np.where(ids > least, REPEAT, -1)
            kind[(w1 == first[0]) & (w2 == first[1]) & (ids == first[2])] = OPEN
            at = (w1[-1], w2[-1], least[-1])
            keep = np.flatnonzero(kind >= 0)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep)) for c in b.columns), pa.array(kind[keep].astype(np.int8))], [*b.schema.names, "kind"])
            last = b.slice(b.num_rows - 1)
        if at is not None:
            yield pa.RecordBatch.from_arrays([*last.columns, pa.array([LAST], pa.int8())], [*last.schema.names, "kind"])

    found = rows.repartitionByRange("w1", "w2", "id").sortWithinPartitions("w1", "w2", "id").mapInArrow(work, "w1 long, w2 int, id long, place long, kind byte")
    found = storage.written(found, "repeats")
    least = found.filter(f"kind = {LAST}").groupBy("w1", "w2").agg(F.min("id").alias("a"))
    late = found.filter(f"kind = {OPEN}").join(least, ["w1", "w2"]).filter("id > a")
    return found.filter(f"kind = {REPEAT}").select("id", "place").unionByName(late.select("id", "place"))


def kept_texts(docs: DataFrame, window: int) -> DataFrame:
    """Cuts the windows at ``places`` (all windows where ``copy``) out of ``text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, copies = b.column("places"), b.column("copy").to_pylist()
            for i, j, texts in flat.pieces(b.column("text")):
                size, gone, out = [], [], []
                for k, t in enumerate(texts, i):
                    words = WORD.findall(t)
                    n = len(words)
                    if copies[k] and n >= window:
                        kept = []
                    elif not places[k].is_valid or n < window:
                        kept = words
                    else:
                        edge = np.zeros(n + 1, np.int64)
                        starts = places[k].values.to_numpy()
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                        covered = np.cumsum(edge[:n]) > 0
                        kept = [x for x, c in zip(words, covered.tolist(), strict=True) if not c]
                    size.append(n)
                    gone.append(n - len(kept))
                    out.append(" ".join(kept))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("carry").slice(i, j - i), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["id", "carry", "n_words", "n_removed", "kept"])

    carry = docs.schema["carry"].dataType.simpleString()
    return docs.select("id", "carry", "text", "places", "copy").mapInArrow(work, f"id long, carry {carry}, n_words long, n_removed long, kept string")


def _lists(rows: DataFrame, name: str) -> DataFrame:
    """id, tag and the list of words of rows (id, place)."""
    word, tag = F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"), F.shiftright("place", 32)
    return rows.select("id", tag.alias("tag"), word.alias("at")).groupBy("id", "tag").agg(F.collect_set("at").alias(name))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one space) and the columns named in ``carry``."""
    held = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.lit(None).cast("boolean")
    text = F.col(text_col).cast("string")
    # 31 bits of the text tell apart the texts that share an id
    every = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.crc32(text).bitwiseAND(0x7FFFFFFF).alias("tag"), held.alias("carry"))
    real = every.filter(F.col("id").isNotNull() & (F.length("text") >= 2 * window - 1)).select("id", "tag", "text")

    digests = real.select("id", "tag", F.unhex(F.md5("text")).alias("digest"))
    first = storage.written(digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first"), "copied")
    copies = storage.written(digests.join(first, "digest").filter("id > first").select("id", "tag").distinct(), "copies")
    storage.drop(first)

    places = storage.written(_lists(shared_anchors(anchors(real, window, seed)), "at"), "anchors")
    hit = real.join(places, ["id", "tag"]).join(copies, ["id", "tag"], "left_anti")
    spans = storage.written(_lists(repeated(extended(hit, window, seed)), "places"), "spans")
    storage.drop(places)

    joined = every.filter("id is not null").join(spans, ["id", "tag"], "left").join(copies.withColumn("copy", F.lit(True)), ["id", "tag"], "left")
    nameless = every.filter("id is null").select("id", "carry", "text", F.lit(None).cast("array<int>").alias("places"), F.lit(False).alias("copy"))
    out = kept_texts(joined.select("id", "carry", "text", "places", F.coalesce("copy", F.lit(False)).alias("copy")).unionByName(nameless), window)
    extra = [F.col(f"carry.`{c}`").alias(c) for c in carry or []]
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *extra)
