"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

Encoding splits each text into pretokens, looks the distinct ones up in a lexicon automaton and merges
those that are not in it, exactly, by rank.  The lexicon holds the most frequent pretokens of the whole
corpus.  It is a minimal acyclic automaton (common suffixes are shared) whose arcs carry additive
outputs: the sum along a word's path is its index, and the index leads to its id sequence.  The arrays
are written once to the shared folder, shipped with ``addFile`` and memory-mapped by every worker.

Defined results: null text encodes as the empty text (0 ids, the digests of nothing); invalid UTF-8
decodes with replacement characters; special tokens' strings in a text are found first and get their id.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import io
import json
import os
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import flat, storage

LETTER, NUMBER, SPACE, OTHER, EDGE = 1, 2, 3, 0, 4
#: The white space of the pattern, as code points.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The suffixes of the pattern after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LONG_WORD = 48


@functools.cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(0x40000):  # no letters or numbers beyond
        if (k := kinds.get(unicodedata.category(chr(c))[0])) is not None:
            table[c] = k
    table[list(WHITE_SPACE)] = SPACE
    return table


def pretokens(cps: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each pretoken; ``edges`` are the positions of the separators after each text."""
    n = len(cps)
    kind = classes()[cps]
    kind[edges] = EDGE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, kind[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = EDGE, kind[1:]
    blank = np.zeros(n, bool)
    blank[1:] = (cps[:-1] == 32) & (before[1:] == SPACE)
    start = (kind != before) & ~(blank & (kind != EDGE))
    start |= (kind == SPACE) & (after != SPACE) & (after != EDGE)
    start |= kind == EDGE
    start |= before == EDGE
    quote = np.flatnonzero(start & (cps == 39) & (kind == OTHER))
    if len(quote):
        padded = np.concatenate((cps, np.zeros(3, cps.dtype)))
        for tail in CONTRACTIONS:
            found = quote
            for k, c in enumerate(tail, 1):
                found = found[padded[found + k] == ord(c)]
            start[found + 1] = False
            start[found + len(tail) + 1] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    real = kind[begin] != EDGE
    return begin[real], end[real]


class Pieces:
    """Distinct pretokens of a batch: ``which`` maps each pretoken to a distinct one, ``raw`` holds their UTF-8.

    ``keys`` are the hashes of the distinct ones, rising; none if two share one.
    """

    def __init__(self, texts: list[str]) -> None:
        cps, starts = flat.code_points(texts)
        self.n_texts = len(texts)
        if not len(cps):
            self.which = self.first = np.zeros(1, np.int64)[:0]
            self.begin = self.end = np.zeros(0, np.int64)
            self.keys = np.zeros(0, np.uint64)
            self.first = np.zeros(len(texts) + 1, np.int64)
            self.raw, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        begin, end = pretokens(cps, starts[1:] - 1)
        self.first = np.searchsorted(begin, starts)
        keys, index, self.which = flat.distinct(flat.span_hashes(cps, begin, end))
        same = end - begin == (end - begin)[index][self.which]
        length = (end - begin)[same]
        ok = same.all() and np.array_equal(np.delete(cps, starts[1:] - 1), cps[flat.ragged(begin[index][self.which], length)])
        if not ok:  # two pretokens share a hash: compare the strings themselves
            joined = [cps[b:e].tobytes() for b, e in zip(begin, end, strict=True)]
            _, index, self.which = np.unique(np.array(joined, object), return_index=True, return_inverse=True)
        self.keys = keys if ok else None
        width = np.uint8(1) + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
        offsets = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(width, out=offsets[1:])
        self.raw = np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        self.at = offsets[begin[index]]
        self.size = offsets[end[index]] - self.at

    def words(self) -> list[bytes]:
        raw = self.raw.tobytes()
        return [raw[a : a + n] for a, n in zip(self.at.tolist(), self.size.tolist(), strict=True)]


def letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}


class Vocabulary:
    """Ids, byte strings and merge ranks of a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte, ids = letters(), model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, k in ids.items():
            self.bytes_of[k] = word.encode() if word in self.special else bytes(byte[c] for c in word)
        for word, k in self.special.items():
            self.bytes_of[k] = word.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.byte_id[b] = ids[c]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
        self.n_merges, self.index = len(keys), flat.HashIndex(keys)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.length, self.offset = lengths, np.cumsum(lengths) - lengths
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._ranks = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; pairs that don't merge get the number of merges."""
        rank = self.index.find((left << 32) | right)
        rank[rank < 0] = self.n_merges
        return rank

    def merge_long(self, word: bytes) -> list[int]:
        """One word by a heap of pairs: for words too long for the rounds of ``merge``."""
        ids = self.byte_id[list(word)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := self._ranks.get((ids[i] << 32) | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x, y in zip(ids, alive, strict=True) if y]

    def merge(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, one after the other, and how many each has: in rounds, the best pair of each word merges."""
        n = len(at)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word of each id, ids)
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            ids = np.array(self.merge_long(raw[at[w] : at[w] + size[w]].tobytes()), np.int64)
            parts.append((np.full(len(ids), w), ids))
        short = np.flatnonzero(size <= LONG_WORD)
        word = np.repeat(short, size[short])
        ids = self.byte_id[raw[flat.ragged(at[short], size[short])]]
        none = self.n_merges
        while len(ids):
            rank = np.full(len(ids), none)
            if len(ids) > 1:
                inside = word[:-1] == word[1:]
                rank[:-1][inside] = self.ranks(ids[:-1][inside], ids[1:][inside])
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(ids)))
            open_ = np.repeat(best < none, count)
            if not open_.all():
                parts.append((word[~open_], ids[~open_]))
                word, ids, rank = word[open_], ids[open_], rank[open_]
                if not len(ids):
                    break
                best, count = best[best < none], count[best < none]
            hit = np.flatnonzero(rank == np.repeat(best, count))
            # of neighbouring hits of one word only the leftmost of each overlapping run merges now
            keep = np.append(True, (np.diff(hit) > 1) | (word[hit[1:]] != word[hit[:-1]])) if len(hit) else np.zeros(0, bool)
            hit = hit[keep]
            ids[hit] = self.made[rank[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            word, ids = word[stay], ids[stay]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        word, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=n)


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lexicon:
    """The transducer: sorted arcs (state, byte) with target and output, final flags, and id sequences by index."""

    NAMES = ("arc", "target", "output", "final", "at", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)
        self.index = flat.HashIndex(self.arc)

    @staticmethod
    def compile(words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> Lexicon:
        """``words`` sorted and distinct; ``ids`` and ``counts`` as ``Vocabulary.merge`` gives them."""
        register: dict[tuple, int] = {}
        children: list[tuple] = []  # of each finished state: (final, ((byte, state), ...))
        size: list[int] = []

        def finish(final: bool, arcs: list[tuple[int, int]]) -> int:
            key = (final, tuple(arcs))
            if (found := register.get(key)) is None:
                found = register[key] = len(children)
                children.append(key)
                size.append(final + sum(size[s] for _, s in arcs))
            return found

        path: list[list] = [[False, []]]
        previous = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1].append((previous[len(path) - 1], finish(final, arcs)))

        for w in words:
            common = next((i for i, (a, b) in enumerate(zip(w, previous, strict=False)) if a != b), min(len(w), len(previous)))
            close(common)
            path.extend([False, []] for _ in range(len(w) - common))
            path[-1][0] = True
            previous = w
        close(0)
        root = finish(*path[0])
        number = {root: 0} | {s: k for k, s in enumerate((s for s in range(len(children)) if s != root), 1)}
        arcs = []
        for s, (final, out) in enumerate(children):
            skipped = int(final)
            for byte, to in out:
                arcs.append((number[s] << 8 | byte, number[to], skipped))
                skipped += size[to]
        arcs.sort()
        finals = np.zeros(len(children), np.uint8)
        for s, (final, _) in enumerate(children):
            finals[number[s]] = final
        a = np.array(arcs, np.int64).reshape(-1, 3)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=at[1:])
        return Lexicon({"arc": a[:, 0].copy(), "target": a[:, 1].copy(), "output": a[:, 2].copy(), "final": finals, "at": at, "ids": ids.astype(np.int32)})

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = [np.ascontiguousarray(getattr(self, n)) for n in self.NAMES]
        head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode().ljust(1024)
        out.write(head)
        for a in arrays:
            out.write(a.tobytes() + bytes(-a.nbytes % 8))
        return out.getvalue()

    @staticmethod
    def open(path: str) -> Lexicon:
        """Memory-maps the arrays of a file that ``to_bytes`` made."""
        with open(path, "rb") as f:
            head = json.loads(f.read(1024))
        where, arrays = 1024, {}
        for name, (kind, n) in zip(Lexicon.NAMES, head, strict=True):
            arrays[name] = np.memmap(path, kind, "r", where, (n,)) if n else np.zeros(0, kind)
            where += -(-n * np.dtype(kind).itemsize // 8) * 8
        return Lexicon(arrays)

    def find(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Index of each word, or -1; all words walk the automaton in step."""
        index = np.full(len(at), -1, np.int64)
        if not len(self.arc):
            return index
        live = np.flatnonzero(size > 0)
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | raw[at[live] + step]
            k = self.index.find(key)
            ok = k >= 0
            live, k, total = live[ok], k[ok], total[ok]
            state, total = self.target[k].astype(np.int64), total + self.output[k]
            step += 1
            done = size[live] == step
            ended = done & (self.final[state] == 1)
            index[live[ended]] = total[ended]
            live, state, total = live[~done], state[~done], total[~done]
        return index


@functools.lru_cache(2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon.open(name if os.path.isabs(name) else SparkFiles.get(name))


def encode(texts: list[str], vocab: Vocabulary, lexicon: Lexicon | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and where each text's ids begin (and the end)."""
    if vocab.special and any(s in t for t in texts for s in vocab.special):
        return _encode_special(texts, vocab, lexicon)
    p = Pieces(texts)
    found = lexicon.find(p.raw, p.at, p.size) if lexicon is not None else np.full(len(p.at), -1, np.int64)
    rest = np.flatnonzero(found < 0)
    ids, counts = vocab.merge(p.raw, p.at[rest], p.size[rest])
    size, begin = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    known = np.flatnonzero(found >= 0)
    pool = ids
    if len(known):
        begin[known] = lexicon.at[found[known]] + len(ids)
        size[known] = lexicon.at[found[known] + 1] - lexicon.at[found[known]]
        pool = np.concatenate((ids, lexicon.ids))
    size[rest], begin[rest] = counts, np.cumsum(counts) - counts
    each = size[p.which]
    sums = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=sums[1:])
    return pool[flat.ragged(begin[p.which], each)], sums[p.first]


def _encode_special(texts: list[str], vocab: Vocabulary, lexicon: Lexicon | None) -> tuple[np.ndarray, np.ndarray]:
    import re

    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(vocab.special, key=len, reverse=True)) + ")")
    parts = [cut.split(t) for t in texts]
    plain = [x for p in parts for x in p[::2]]
    ids, at = encode(plain, vocab, lexicon)
    out, begin, k = [], [0], 0
    for p in parts:
        for i, x in enumerate(p):
            if i % 2:
                out.append(np.array([vocab.special[x]], np.int64))
            else:
                out.append(ids[at[k] : at[k + 1]])
                k += 1
        begin.append(begin[-1] + sum(map(len, out[len(out) - len(p) :])))
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(begin, np.int64)


def decode(ids: np.ndarray, at: np.ndarray, vocab: Vocabulary) -> list[str]:
    """Text of each id sequence; ``at`` as ``encode`` gives it."""
    length = vocab.length[ids]
    raw = vocab.blob[flat.ragged(vocab.offset[ids], length)].tobytes()
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    cuts = ends[at].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def word_counts(docs: DataFrame, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """Pretokens (binary) of all texts with their number: summed in each task, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for i, j in flat.chunks([len(t) for t in texts]):
                p = Pieces(texts[i:j])
                n = np.bincount(p.which, minlength=len(p.at)) if len(p.which) else []
                for w, k in zip(p.words(), n, strict=True):
                    held[w] += int(k)
                if len(held) > flush:
                    yield out()
        if held:
            yield out()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(spark: SparkSession, docs: DataFrame, vocab_path: str, text_col: str = "text", share: int = 1 << 20, longest: int = LONG_WORD) -> str:
    """Compiles the frequent pretokens of ``docs``: those that begin more often than once in ``share`` characters.

    That bounds the lexicon by ``share`` words at any size of the corpus (frequencies add up to one), so what reaches the
    driver does not grow with the input.  Returns the name of the file that workers map.
    """
    chars = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    least = max(2, 1 + chars // share)
    rows = word_counts(docs, text_col).filter((F.length("word") <= longest) & (F.col("n") >= least)).collect()
    words = sorted(bytes(r.word) for r in rows)
    vocab = vocabulary(vocab_path)
    raw = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    ids, n = vocab.merge(raw, np.cumsum(sizes) - sizes, sizes)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(storage.write_bytes(spark, name, Lexicon.compile(words, ids, n).to_bytes()))
    return name


def encode_documents(spark: SparkSession, docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids array<int>, decoded string (the decoding of ids)."""
    name = build_lexicon(spark, docs, vocab_path, text_col)
    return _encoded(docs, vocab_path, name, id_col, text_col, False)


def encode_digests(spark: SparkSession, docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with digests in place of the ids and the decoded text."""
    name = build_lexicon(spark, docs, vocab_path, text_col)
    return _encoded(docs, vocab_path, name, id_col, text_col, True)


def _encoded(docs: DataFrame, vocab_path: str, name: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lexicon = vocabulary(vocab_path), _lexicon(name)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in flat.chunks([len(t) for t in texts]):
                ids, at = encode(texts[i:j], vocab, lexicon)
                back = decode(ids, at, vocab)
                head = [b.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64())]
                small = ids.astype("<u4")
                if digests:
                    rest = [
                        pa.array([hashlib.sha256(small[a:z].tobytes()).hexdigest() for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.string()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back], pa.string()),
                    ]
                else:
                    rest = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(small.astype(np.int32))), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(head + rest, ["id", "n_tokens", "a", "b"])

    kind = "id long, n_tokens long, " + ("a string, b string" if digests else "a array<int>, b string")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, kind)
    return out.toDF(id_col, "n_tokens", *names)
