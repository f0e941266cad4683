"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A frame holds whole documents in ascending id order: ``MAGIC``, a header (little-endian unsigned 64-bit: documents,
ids, blocks), the document table (ids and lengths, zlib), the block table (for each block number of ids, number of
distinct ids, bytes of its head, words of its code, CRC-32 of its ids), then for each block its head and code.

Each block of ``BLOCK`` ids is coded on its own, from a fresh model: ``mixer`` mixes distributions of orders 0 to 2 and
codes the lanes of a block in step.

Frames are rows of a Parquet table, which Spark commits atomically.  Defined results: null text has only the end id;
null document ids sort first and come back as null; rows that repeat an id follow each other.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bpe, flat, mixer, storage

MAGIC = b"NGTOK3\0\0"
BLOCK, FRAME_IDS = 1 << 21, 1 << 21
TEXT_CHARS, KNOWN_WORDS, PART_BYTES = 1 << 20, 600_000, 1 << 27
NULL_ID = -(1 << 63)
_LETTERS = np.array([ord(c) for _, c in sorted((b, c) for c, b in bpe.letters().items())], "<u4")


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One frame."""
    table, payload = [], []
    for i in range(0, len(ids), BLOCK):
        b = ids[i : i + BLOCK]
        head, code = mixer.encode_block(b)
        table.append((len(b), len(mixer.alphabet(b)[0]), len(head), len(code), zlib.crc32(b.astype("<u4").tobytes())))
        payload += [head, code.astype("<u2").tobytes()]
    keys = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    docs = zlib.compress(keys.tobytes() + np.asarray(lengths, "<u4").tobytes(), 1)
    return b"".join([MAGIC, struct.pack("<4Q", len(keys), len(ids), len(table), len(docs)), docs, np.array(table, "<u4").tobytes(), *payload])


def unpack(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a frame; raises if a checksum differs."""
    if frame[:8] != MAGIC:
        raise ValueError("not a token frame")
    n_docs, n_ids, n_blocks, n_table = struct.unpack_from("<4Q", frame, 8)
    at = 40
    docs = zlib.decompress(frame[at : at + n_table])
    keys, lengths = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<u4", n_docs, 8 * n_docs).astype(np.int64)
    at += n_table
    table = np.frombuffer(frame, "<u4", 5 * n_blocks, at).reshape(-1, 5)
    at += table.nbytes
    blocks: list[np.ndarray] = []
    for n, n_names, n_head, n_code, crc in table.tolist():
        block = mixer.decode_block(frame[at : at + n_head], np.frombuffer(frame, "<u2", n_code, at + n_head), n, n_names)
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        blocks.append(block)
        at += n_head + 2 * n_code
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
    if len(ids) != n_ids:
        raise ValueError("a frame lacks ids")
    return [None if k == NULL_ID else k for k in keys.tolist()], lengths, ids


class Known:
    """Pretokens that the library was asked about, and their ids; the first ``KNOWN_WORDS`` are kept.

    They are found by the hash of their code points, and their bytes are compared.
    """

    def __init__(self) -> None:
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by rising hash
        self.raw, self.pool = _Run(np.uint8), _Run(np.int32)

    def find(self, p: bpe.Pieces) -> np.ndarray:
        """Number of each distinct pretoken, or -1."""
        out = np.full(len(p.at), -1, np.int64)
        if p.keys is None or not len(self.keys):
            return out
        place = np.minimum(np.searchsorted(self.keys, p.keys), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[place] == p.keys)
        number, size = self.number[place[at]], p.size[at]
        same = self.raw.size(number) == size
        at, number, size = at[same], number[same], size[same]
        differ = p.raw[flat.ragged(p.at[at], size)] != self.raw.items[flat.ragged(self.raw.begin[number], size)]
        out[at] = number
        out[at[np.searchsorted(np.cumsum(size), np.flatnonzero(differ), "right")]] = -1
        return out

    def add(self, p: bpe.Pieces, new: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Pretokens ``new`` of ``p`` with the number of their ids, and all these ids."""
        n = min(len(new), KNOWN_WORDS - self.raw.n)
        if n <= 0 or p.keys is None:
            return
        new, size = new[:n], size[:n]
        number = np.arange(self.raw.n, self.raw.n + n, dtype=np.int32)
        self.raw.add(p.size[new], p.raw[flat.ragged(p.at[new], p.size[new])])
        self.pool.add(size, ids[: int(size.sum())])
        place = np.searchsorted(self.keys, p.keys[new])
        self.keys, self.number = np.insert(self.keys, place, p.keys[new]), np.insert(self.number, place, number)


class _Run:
    """Sequences, one after the other, in an array that grows; ``begin`` has where each begins, and the end."""

    def __init__(self, kind: type) -> None:
        self.n, self.begin, self.items = 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 17, kind)

    def size(self, which: np.ndarray) -> np.ndarray:
        return self.begin[which + 1] - self.begin[which]

    def behind(self, items: np.ndarray) -> int:
        """Puts items behind the sequences, where the next call or ``add`` overwrites them; returns where they begin."""
        used = int(self.begin[self.n])
        while used + len(items) > len(self.items):
            self.items = np.append(self.items, np.zeros_like(self.items))
        self.items[used : used + len(items)] = items
        return used

    def add(self, size: np.ndarray, items: np.ndarray) -> None:
        used, n = self.behind(items), self.n + len(size)
        while n + 1 > len(self.begin):
            self.begin = np.append(self.begin, np.zeros_like(self.begin))
        self.begin[self.n + 1 : n + 1] = used + np.cumsum(size)
        self.n = n


@functools.lru_cache(2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, [x.content for x in t.get_added_tokens_decoder().values()], Known()


@functools.cache
def _gaps() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x40000)])  # no letters or numbers beyond


def _unassigned(raw: np.ndarray) -> bool:
    """Whether UTF-8 has code points that Python does not know: the library may know them as letters or numbers."""
    if not len(raw) or raw.max() < 0xCD:  # below U+0340
        return False
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    return bool(_gaps()[cps[cps < 0x40000]].any())


def _asked(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each text, and all ids."""
    found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(itertools.chain.from_iterable(found), np.int64)


def _asked_words(tokenizer, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_asked``, for pretokens (their UTF-8, one after the other): these go to the library's model, in its letters for bytes."""
    joined = _LETTERS[raw].tobytes().decode("utf-32-le")
    merged, ends = tokenizer.model.tokenize, np.cumsum(size).tolist()
    found = [merged(joined[a:z]) for a, z in zip([0, *ends], ends, strict=False)]
    return np.fromiter(map(len, found), np.int64, len(found)), np.array([t.id for w in found for t in w], np.int64)


def library_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts by the tokenizers library: its model is asked once for each distinct pretoken it has not met.

    Texts near special tokens or code points that Python does not know are given to the library whole.
    """
    tokenizer, special, known = _library(path)
    if any(s in t for t in texts for s in special):
        size, ids = _asked(tokenizer, texts)
        return ids, np.append(0, np.cumsum(size))
    p = bpe.Pieces(texts)
    number = known.find(p)
    new = np.flatnonzero(number < 0)
    raw = p.raw[flat.ragged(p.at[new], p.size[new])]
    if _unassigned(raw):
        size, ids = _asked(tokenizer, texts)
        return ids, np.append(0, np.cumsum(size))
    more, ids = _asked_words(tokenizer, raw, p.size[new])
    size, begin = known.pool.size(number), known.pool.begin[number]
    size[new], begin[new] = more, known.pool.behind(ids) + np.cumsum(more) - more
    each = size[p.which]
    out = known.pool.items[flat.ragged(begin[p.which], each)].astype(np.int64)
    known.add(p, new, more, ids)
    return out, np.append(0, np.cumsum(each))[p.first]


def write(docs: DataFrame, path: str, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None) -> None:
    """Encodes all texts and writes their frames, in ascending id order."""
    spark = docs.sparkSession
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, held = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def frame() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            data = pack(keys, np.concatenate(sizes), ids)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["shard", "number", "n_ids", "frame"])
            keys.clear(), parts.clear(), sizes.clear()
            return out

        for b in batches:
            names = b.column(0).to_pylist()
            for i, j, texts in flat.pieces(b.column(1), TEXT_CHARS):
                ids, at = library_ids(texts, vocab_path)
                count = np.diff(at) + 1
                full = np.full(len(ids) + j - i, end_id, np.int64)
                stay = np.ones(len(full), bool)
                stay[np.cumsum(count) - 1] = False
                full[stay] = ids
                keys += names[i:j]
                parts.append(full)
                sizes.append(count)
                held += len(full)
                if held >= FRAME_IDS:
                    yield frame()
                    number, held = number + 1, 0
        if keys:
            yield frame()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.withColumn("tag", F.xxhash64("text")).repartitionByRange(partitions, "id", "tag").sortWithinPartitions("id", "tag")
    with storage.tidy(spark):
        dealt.select("id", "text").mapInArrow(work, "shard int, number int, n_ids long, frame binary").write.parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """id, start, n_tokens, ids_crc32 and, if ``ids``, the ids of every document of the files."""
    frames = spark.read.parquet(path)
    order = Window.partitionBy("shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    totals = frames.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row for each partition written
    before, sums = 0, []
    for r in totals:
        sums.append((r.shard, before))
        before += r.n
    starts = frames.select("shard", "number", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("inside"))
    starts = starts.join(F.broadcast(spark.createDataFrame(sums, "shard int, offset long")), "shard").select("shard", "number", (F.col("inside") + F.col("offset")).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, number, data in zip(*(b.column(k) for k in ("shard", "number", "frame")), strict=True):
                keys, lengths, found = unpack(data.as_py())
                ends = np.cumsum(lengths)
                small = found.astype("<u4")
                for a in range(0, len(keys), 4096):
                    n, z, e = keys[a : a + 4096], lengths[a : a + 4096], ends[a : a + 4096]
                    cols = [
                        pa.array([shard.as_py()] * len(n), pa.int32()),
                        pa.array([number.as_py()] * len(n), pa.int32()),
                        pa.array(n, pa.int64()),
                        pa.array(e - z),
                        pa.array(z),
                        pa.array([zlib.crc32(small[s:t].tobytes()) for s, t in zip((e - z).tolist(), e.tolist(), strict=True)], pa.int64()),
                    ]
                    if ids:
                        own = small[e[0] - z[0] : e[-1]].astype(np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(z)).astype(np.int32)), pa.array(own)))
                    yield pa.RecordBatch.from_arrays(cols, ["shard", "number", "id", "inner", "n_tokens", "ids_crc32", *["ids"] * ids])

    kind = "shard int, number int, id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    docs = frames.select("shard", "number", "frame").mapInArrow(work, kind)
    out = docs.join(starts, ["shard", "number"])
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
