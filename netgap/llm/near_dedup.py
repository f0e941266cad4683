"""Near-duplicate detection by order MinHash, verified by banded alignment.

Texts are sequences of words ``[^\\x20\\x09-\\x0D]+``; their k-mers are labelled with their occurrence number.  Each hash
function of a ``Scale`` picks the smallest labelled k-mers and keeps them in text order: two texts agree on such a value
only if they share those k-mers in the same order, which follows edit similarity.  All texts are sketched by k-mers of
five words; short texts, where a few edits touch most of these, also by shorter ones.  Texts that agree on a value (share
a bucket) are candidates; a pair is a link if the edit distance of their words is at most (1 - ``SIMILARITY``) of the
longer one, found by alignment inside the band which that budget allows.  Classes are the connected components of links,
and of exact copies.

1. Exact copies are folded into one representative for each text.
2. Sketch values are sorted once, by range of (value, hash of the id), so a bucket of any size is dealt over as many
   tasks as its size asks for.  Each task walks its rows and compares every member of a bucket with the first it has
   met.  Ids are in the same order in every bucket, so buckets with the same members give the same pairs.
3. The pass over buckets that still hold several classes is exact: every pair of different classes is compared, and
   aligned unless lengths or word counts rule a link out.  So the classes are those of all links between texts that
   agree on a value, whichever members came first.  Most buckets are one cell, with a row for each member.  Where the
   blocks of a bucket would repeat its members more than ``SPREAD`` times, they meet by their rarest pairs of words
   instead, which two linked texts must share (``rarest``), if that takes fewer rows.

Defined results: null texts and texts without words are alone in their class; null ids have no row; rows that repeat an
id are one document, whose class holds the links of all its texts; texts of any length are sketched and aligned whole;
ties (equal texts, equal hashes) go to the smaller id; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netgap.operators import components

from . import align, flat, storage


@dataclass(frozen=True)
class Scale:
    """``functions`` hashes, each of which picks ``picked`` k-mers of ``k`` words, for texts of up to ``words`` words."""

    k: int
    picked: int
    functions: int
    words: int | None = None


SIMILARITY = 0.8
#: Five words for all texts; the others make up for the few five-word runs that edits leave in short texts.
SCALES = (Scale(5, 2, 80), Scale(2, 4, 32, 125), Scale(1, 3, 32, 50))
#: Members of a block of the exact pass, and bins of its word counts.
BLOCK, BINS = 2048, 128
#: Rows a member, above which a bucket is split by rare pairs of words; texts, characters and pairs for their order.
SPREAD = 8
ORDER_TEXTS, ORDER_CHARS, ORDER_PAIRS = 4096, 4000, 1 << 16
LONG = 1 << 19
_SEEDS = flat.mix64(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def labelled(keys: np.ndarray) -> np.ndarray:
    """Mixes the occurrence number of each key into it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    number = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    out = np.empty_like(keys)
    out[order] = flat.mix64(s + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def sketch(words: np.ndarray, scales: tuple[Scale, ...] = SCALES) -> np.ndarray:
    """Order MinHash values of one text of at least one word, given the hashes of its words."""
    out, at = [], 0
    for scale in scales:
        seeds = _SEEDS[at : at + scale.functions]
        at += scale.functions
        if scale.words is None or len(words) <= scale.words:
            out.append(values(labelled(flat.windows(words, min(scale.k, len(words)))), seeds, scale.picked))
    return np.concatenate(out)


def values(keys: np.ndarray, seeds: np.ndarray, picked: int) -> np.ndarray:
    """For each seed a hash of the ``picked`` keys that are smallest under it, in their order."""
    picked = min(picked, len(keys))
    small = (keys >> np.uint64(32)).astype(np.uint32)
    turn, odd = (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)
    out = seeds.copy()
    rows = max(1, LONG // len(keys))
    for a in range(0, len(seeds), rows):
        h = (small ^ turn[a : a + rows, None]) * odd[a : a + rows, None]
        line = np.arange(len(h))
        at = np.empty((len(h), picked), np.int64)
        for p in range(picked):
            at[:, p] = h.argmin(1)
            h[line, at[:, p]] = np.uint32(0xFFFFFFFF)
        at.sort(1)
        for p in range(picked):
            out[a : a + rows] = flat.mix64(out[a : a + rows] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[at[:, p]])
    return out


def sketches(docs: DataFrame, scales: tuple[Scale, ...] = SCALES) -> DataFrame:
    """id, digest, number of words, order MinHash values, word counts by bin of rows (id, text, digest); texts with a word only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in flat.pieces(b.column("text")):
                w = flat.Words(texts)
                h, count = w.hashes(), w.counts()
                own = [h[w.first[x] : w.first[x + 1]] for x in np.flatnonzero(count)]
                found = [sketch(x, scales).view(np.int64) for x in own]
                bins = [np.minimum(np.bincount((x % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes() for x in own]
                part = b.slice(i, j - i).take(pa.array(np.flatnonzero(count)))
                ends = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                sig = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), pa.array(count[count > 0], pa.int32()), sig, pa.array(bins, pa.binary())], ["id", "digest", "n", "sig", "bins"])

    return docs.select("id", "text", "digest").mapInArrow(work, "id long, digest binary, n int, sig array<long>, bins binary")


def members(buckets: DataFrame) -> DataFrame:
    """key, id, n, and the leader (lead, lead_n) of each row (key, id, n) that shares its key with another.

    The leader is the first row of the key in the task's range.  A row at either end of a range may share its key with
    rows of the next range: it is returned, alone or not, and left to the exact pass.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "n", "lead", "lead_n"]
        last = lead = None  # key and leader (id, n) of the rows before
        waiting = None  # the row before, if it is the only one of its key so far
        at_head = True
        for b in batches:
            if not b.num_rows:
                continue
            key, ids, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "n"))
            new = np.append(last is None or key[0] != last, key[1:] != key[:-1])
            if waiting is not None and not new[0]:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(pa.array, waiting), strict=True)), schema)
                waiting = None
            begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            who, size = ids[begin], n[begin]
            if not new[0]:
                who, size = np.where(begin < 0, lead[0], who), np.where(begin < 0, lead[1], size)
            out = ~new
            out[:-1] |= ~new[1:]
            out[0] |= at_head
            at_head = False
            waiting = None if out[-1] else ([key[-1]], [ids[-1]], [n[-1]], [who[-1]], [size[-1]])
            last, lead = key[-1], (who[-1], size[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[out], f.type) for x, f in zip((key, ids, n, who, size), schema, strict=True)], schema=schema)
        if waiting is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(pa.array, waiting), strict=True)), schema)

    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("lead", pa.int64()), ("lead_n", pa.int32())])
    ranked = buckets.select("key", F.xxhash64("id").alias("h"), "id", "n")
    return ranked.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "id").select("key", "id", "n").mapInArrow(work, "key long, id long, n int, lead long, lead_n int")


def _close(n: str, m: str, similarity: float) -> F.Column:
    """Whether the lengths allow a link."""
    return F.least(n, m) >= F.ceil(F.lit(similarity) * F.greatest(n, m) - 1e-9)


def pairs_of_words(words: np.ndarray) -> np.ndarray:
    """Labelled hashes of each word with the one before it (the first: with none), given the hashes of the words."""
    return labelled(flat.windows(np.append(np.uint64(0), words), 2))


def common_pairs(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest pairs of words of a uniform sample of rows (id, text), sorted, and in how many texts each stands."""
    sample = texts.orderBy(F.xxhash64("id"), "id").limit(ORDER_TEXTS).select(F.substring("text", 1, ORDER_CHARS)).collect()
    w = flat.Words([r[0] for r in sample])
    h = w.hashes()
    found = [pairs_of_words(h[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    keys, times = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
    top = np.sort(np.lexsort((keys, -times))[:ORDER_PAIRS])
    return keys[top], times[top]


def rarest(texts: DataFrame, similarity: float) -> DataFrame:
    """id, rare: the rarest labelled pairs of words of rows (id, text), so many that linked texts share one of them.

    An edit changes two pairs at most.  So texts of up to N words with L edits share N - 2 L pairs, and in any common
    order one of the first n - (N - 2 L) + 1 of each, which is 2 L(n) + 2 at most for a text of n words and a similarity
    over a half.  The order only decides how many texts share one: rare ones of a sample come first.
    """
    known, times = common_pairs(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, part in flat.pieces(b.column("text")):
                w = flat.Words(part)
                h, found = w.hashes(), []
                for a, e in zip(w.first[:-1], w.first[1:], strict=True):
                    keys = pairs_of_words(h[a:e])
                    at = np.searchsorted(known, keys)
                    seen = np.where(np.append(known, 0)[at] == keys, np.append(times, 0)[at], 0)
                    found.append(keys[np.lexsort((keys, seen))[: 2 * int((1 - similarity) * len(keys) + 1e-9) + 2]].view(np.int64))
                ends = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), rare], ["id", "rare"])

    return texts.select("id", "text").mapInArrow(work, "id long, rare array<long>")


def blocks(named: DataFrame) -> DataFrame:
    """key, largest class ``top``, and numbers of blocks of it (nm) and of the other members (nr) of each bucket of several
    classes, the ``rows`` that they take, and ``wide`` if these are over ``SPREAD`` a member.  Written."""
    sizes = named.groupBy("key", "c").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("size"), F.count("*").alias("z")).filter("z > 1")
    mixed = mixed.select("key", F.col("top.c").alias("top"), F.col("top.m").alias("m"), F.expr("size - top.m").alias("r"))
    mixed = mixed.withColumn("nm", F.expr(f"int((m + {BLOCK - 1}) div {BLOCK})")).withColumn("nr", F.expr(f"int((r + {BLOCK - 1}) div {BLOCK})"))
    mixed = mixed.withColumn("rows", F.expr("m * nr + r * (nm + nr - 1)"))
    return storage.written(mixed.select("key", "top", "nm", "nr", "rows", F.expr(f"rows > {SPREAD} * (m + r)").alias("wide")), "mixed")


def dealt(named: DataFrame, mixed: DataFrame, fine: bool) -> DataFrame:
    """The rows (key, id, n, c) of the buckets in ``mixed``, once for each cell that they take part in."""
    placed = named.join(mixed.select("key", "top", "nm", "nr"), "key").withColumn("at", F.expr("int(pmod(xxhash64(id), if(c = top, nm, nr)))"))
    cells = F.expr("""if(c = top, transform(sequence(0, nr - 1), i -> struct(i, at as x, 0 as side)), concat(
        transform(sequence(0, nm - 1), x -> struct(at as i, x, if(x = 0, 2, 1) as side)),
        filter(transform(sequence(0, nr - 1), j -> struct(least(at, j) as i, nm + greatest(at, j) as x, if(j < at, 1, 0) as side)), y -> y.x <> nm + y.i)))""")
    rows = placed.select("key", "id", "n", "c", F.explode(cells).alias("y"))
    return rows.select(F.xxhash64("key", "y.i", "y.x", F.lit(fine)).alias("cell"), "key", F.lit(fine).alias("fine"), F.col("y.side").alias("side"), "id", "n", "c")


def crossing(named: DataFrame, reps: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes c of each bucket of rows (key, id, n, c), written.

    The members outside the largest class are cut into blocks; each meets every block of that class, itself and the
    later blocks.  A cell is one meeting of two blocks, and the first with the largest class also that of a block with
    itself: a bucket of two blocks is one cell.  Members of ``wide`` buckets are dealt by ``rarest`` pairs of words
    instead, if that takes fewer rows.
    First only those members are kept for which lengths and word counts (``reps``: id, sig, bins) allow a link with a
    member of another class; then their texts are aligned within the cell.  A pair that shares several buckets is aligned
    in that of its first common value (or least common pair of words) only, and not at all if the cell has joined its
    classes already.  So a cell returns fewer links than it has rows.
    """
    mixed = blocks(named)
    wide = mixed.filter("wide")
    more = texts.join(reps.select("id", "sig"), "id")
    old = [mixed]
    if similarity <= 0.5 or wide.isEmpty():
        rows, more = dealt(named, mixed, False), more.withColumn("rare", F.lit(None).cast("array<long>"))
    else:
        hot = storage.written(named.join(wide.select("key"), "key").select("id", "n", "c").distinct(), "hot")
        rare = storage.written(rarest(texts.join(hot.select("id"), "id"), similarity), "rare")
        finer = hot.join(rare, "id").select(F.explode("rare").alias("key"), "id", "n", "c")
        again = blocks(finer)
        total = lambda t: t.agg(F.sum("rows")).first()[0] or 0
        if total(again) < total(wide):
            rows = dealt(named, mixed.filter("not wide"), False).unionByName(dealt(finer, again, True))
        else:  # members that share rare pairs of words, too
            rows = dealt(named, mixed, False)
        more = more.join(rare, "id", "left")
        old += [hot, rare, again]
    rows = storage.written(attached(rows, reps.select("id", "bins")), "cells")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches):
            hit = np.zeros(len(t), bool)
            for x, y, _ in meetings(t, similarity):
                hit[x] = hit[y] = True
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches):
            if found := joining(t, similarity):
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    kept = storage.written(by_cell(rows).mapInArrow(near, rows.schema), "near")
    found = storage.written(by_cell(attached(kept, more)).mapInArrow(joined, "a long, b long").distinct(), "joined")
    storage.drop(rows, kept, *old)
    return found


def attached(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``more`` (one row an id), which meets each id once, with the list of its rows."""
    own = [c for c in rows.columns if c != "id"]
    lists = rows.groupBy("id").agg(F.collect_list(F.struct(*own)).alias("own"))
    return lists.join(more, "id").select("id", *[c for c in more.columns if c != "id"], F.inline("own"))


def by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell", "id")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after the other."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        cell = b.column("cell").to_numpy()
        cut = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell)).tolist()
        if rest and rest[0].column("cell")[0].as_py() != cell[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        begin = 0
        for end in cut[:-1]:
            yield pa.Table.from_batches([*rest, b.slice(begin, end - begin)])
            rest, begin = [], end
        rest.append(b.slice(begin))
    if rest:
        yield pa.Table.from_batches(rest)


def meetings(t: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows x and y of a cell whose classes differ, where lengths and word counts allow a link, and the least number of
    edits by these counts: members of side 0 with those of sides 1 and 2, those of side 2 with each other."""
    side, n, c = (t[x].to_numpy() for x in ("side", "n", "c"))
    at = [np.flatnonzero(side == k) for k in range(3)]
    bins = None
    for left, right, own in ((at[0], np.flatnonzero(side > 0), False), (at[2], at[2], True)):
        for k in range(0, len(left) if len(right) else 0, 256):
            x = left[k : k + 256]
            limit = np.floor((1 - similarity) * np.maximum(n[x][:, None], n[right]) + 1e-9)
            good = (c[x][:, None] != c[right]) & (abs(n[x][:, None] - n[right]) <= limit)
            if own:
                good &= x[:, None] < right
            i, j = np.nonzero(good)
            if len(i) and bins is None:
                bins = np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(-1, BINS)
            for m in range(0, len(i), 1 << 13):
                p, q = x[i[m : m + (1 << 13)]], right[j[m : m + (1 << 13)]]
                d = bins[p].astype(np.int16) - bins[q]
                over = np.maximum(d, 0).sum(1)  # an edit changes one count up and one down at most
                least = np.maximum(over, over - d.sum(1))
                near = least <= limit[i[m : m + (1 << 13)], j[m : m + (1 << 13)]]
                if near.any():
                    yield p[near], q[near], least[near]


def joining(t: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links that join the classes of a cell, found by alignment, nearest pairs first."""
    ids, c, column, key = t["id"].to_pylist(), t["c"].to_pylist(), t["text"], t["key"][0].as_py()
    sig = t["sig"].combine_chunks()
    size = np.diff(sig.offsets.to_numpy())
    values = np.zeros((len(t), int(size.max())), np.int64)
    values[np.arange(values.shape[1]) < size[:, None]] = sig.flatten().to_numpy()
    fine, rare = t["fine"][0].as_py(), {}
    texts: dict[int, Text] = {}
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while (w := up.get(v, v)) != v:
            up[v] = up.get(w, w)
            v = w
        return v

    def text(k: int) -> Text:
        if k not in texts:
            texts[k] = Text(column[k].as_py())
        return texts[k]

    def least_shared(p: int, q: int) -> int:
        for k in (p, q):
            if k not in rare:
                rare[k] = frozenset(t["rare"][k].as_py())
        return min(rare[p] & rare[q])

    found = []
    for x, y, least in meetings(t, similarity):
        same = values[x] == values[y]
        first = same.argmax(1)  # of values, there is one before the shorter one's end, as both hold ``key``
        if fine:
            own = np.flatnonzero(same[np.arange(len(x)), first] & (first < np.minimum(size[x], size[y])))
            own = own[[least_shared(p, q) == key for p, q in zip(x[own].tolist(), y[own].tolist(), strict=True)]] if len(own) else own
        else:
            own = np.flatnonzero(values[x, first] == key)
        own = own[np.argsort(least[own], kind="stable")]
        for p, q in zip(x[own].tolist(), y[own].tolist(), strict=True):
            u, v = top(c[p]), top(c[q])
            if u != v and text(p).distance(text(q), similarity) is not None:
                up[max(u, v)] = min(u, v)
                found.append((ids[p], ids[q]))
    return found


def aligned(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose words align within the budget, with their distance, written."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, distances = [], []
            x, y = b.column("ta"), b.column("tb")
            for k in range(b.num_rows):
                if (d := linked(x[k].as_py(), y[k].as_py(), similarity)) is not None:
                    hits.append(k)
                    distances.append(d)
            at = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at), pa.array(distances, pa.int64())], ["a", "b", "distance"])

    return storage.written(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long, distance long"), "links")


class Text:
    """The words of a text, and how often each stands in it."""

    def __init__(self, text: str) -> None:
        from .substring_dedup import WORD

        self.words = WORD.findall(text)
        self.counts = Counter(self.words)

    def distance(self, other: Text, similarity: float) -> int | None:
        """Edit distance of the words if it is within the budget."""
        longest = max(len(self.words), len(other.words))
        limit = int((1 - similarity) * longest + 1e-9)
        if not longest or longest - (self.counts & other.counts).total() > limit:
            return None
        d = align.banded_distance(self.words, other.words, limit)
        return d if d <= limit else None


def linked(s: str, t: str, similarity: float) -> int | None:
    return Text(s).distance(Text(t), similarity)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, scales: tuple[Scale, ...] = SCALES) -> DataFrame:
    """id, class_id (smallest id of its class), one row per distinct non-null id."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    full = plain.filter(F.col("text").isNotNull())
    full = full.withColumn("digest", F.unhex(F.md5("text")))
    digests = storage.written(full.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("id", "digest"), "digests")
    odd = storage.written(digests.groupBy("id").agg(F.min("digest").alias("own"), F.max("digest").alias("other")).filter("own < other").select("id", "own"), "odd")
    one = lambda t: t.join(odd, "id", "left").filter("own is null or own = digest").drop("own")
    full = one(full)
    own = one(digests)
    many = own.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").select("digest", "rep")
    copies = storage.written(own.join(many, "digest").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "copies")

    reps = storage.written(sketches(full, scales).groupBy("digest").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("bins").alias("bins")), "representatives")
    shared = storage.written(members(reps.select("id", "n", F.explode("sig").alias("key"))), "members")
    texts = full.join(shared.select("id").distinct(), "id", "left_semi").select("id", "text").dropDuplicates(["id"])
    texts = storage.written(texts, "texts")
    tried = shared.filter((F.col("id") != F.col("lead")) & _close("n", "lead_n", similarity))
    tried = storage.written(tried.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), "pairs")
    links = aligned(tried, texts, similarity)

    labels = components.connected(links)
    named = shared.select("key", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("c"))
    more = crossing(named, reps, texts, similarity)
    storage.drop(digests, odd, reps, shared, texts, tried, links)
    final = components.connected(copies.unionByName(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))).unionByName(more))
    storage.drop(copies, labels, more)
    ids = plain.select("id").distinct()
    return ids.join(final.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(id_col), F.coalesce("label", "id").alias("class_id"))
