"""An adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own: its distinct ids (the alphabet) with their counts, to a quarter of a bit, stand in its head,
and its model starts afresh.  Ids of falling count are dealt into ``BUCKETS`` buckets of about equal share, the common ones
alone; an id is coded as its bucket and its place there.  Three adaptive distributions over all buckets, of order 0, of
order 1 (given the last id) and of order 2 (given the last two), are mixed with weights that depend on whether their
contexts were seen and follow what each would have given (one step of expectation-maximisation).  The place is coded by
adaptive order-0 frequencies.  Both go into one interval of a carry-less 64-bit range coder.

Ids get contexts of order 2 by their frequency: common ones many, which the bucket of the id before tells apart, rare ones
share one.  So a context of order 2 lies in one of order 1, and the three distributions are mixed once for each when the
model is brought up to date, not for each id.

A block is cut into lanes, which are coded in step and share one model; it is brought up to date between segments of
steps that grow with the block.  So every step is a few array operations over all lanes.  All arithmetic on which both
sides depend is on integers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np

from . import flat

U = np.uint64
BUCKETS, WIDE, LEVEL, PLACE = 256, 257, 14, 12  # bits of a distribution, and of the places in a bucket
SHARE, SPAN = 12, 16  # bits of the weights, and of the mixture
CONTEXTS, EACH = 8192, 4  # most contexts of order 2; each so many-th id tells what the orders have earned
LANES, STEPS = 8192, 256  # most lanes of a block, least steps of a lane
ROWS = 256  # contexts brought up to date at once: what they take stays in the processor's cache
TOP, BOTTOM = U(1 << 48), U(1 << 32)
_ROOT = np.array([math.isqrt(math.isqrt(1 << q)) for q in range(256)], dtype=object)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts to a quarter of a bit, as one byte each."""
    return np.minimum(255, np.floor(4 * np.log2(counts))).astype(np.uint8)


class Model:
    """The shared model of all lanes of a block of ``n`` ids, given the levels of its alphabet."""

    def __init__(self, level: np.ndarray, n: int) -> None:
        k = len(level)
        mass = _ROOT[level].astype(np.int64)
        order = np.argsort(-mass, kind="stable")
        most = max(1, -(-2 * k // BUCKETS))  # ids of a bucket
        if most > 1 << (PLACE - 1):
            raise ValueError("the alphabet is too large")
        self.bucket = np.zeros(k, np.int64)
        left, now, b, held = int(mass.sum()), 0, 0, 0
        for x, m in zip(order.tolist(), mass[order].tolist(), strict=True):
            if held and b < BUCKETS - 1 and (now * (BUCKETS - b) >= left or held >= most):
                left, now, b, held = left - now, 0, b + 1, 0
            self.bucket[x] = b
            now, held = now + m, held + 1
        self.order = np.lexsort((np.arange(k), self.bucket))
        self.first = np.searchsorted(self.bucket[self.order], np.arange(BUCKETS + 1))
        self.seen = np.maximum(1, mass * 1024 // max(1, int(mass.sum())))
        rows = max(256, min(CONTEXTS, 1 << (n // 64).bit_length()))
        ends = np.cumsum(mass[order]) * (rows - 1) // max(1, int(mass.sum()))
        begin = np.append(0, ends[:-1])
        self.base, self.split, self.dealt = np.zeros(k + 1, np.int64), np.ones(k + 1, np.int64), np.append(0, self.bucket)  # 0: no id before
        self.base[order + 1], self.split[order + 1] = 1 + begin, np.maximum(1, ends - begin)
        opens, wide = np.ones(rows, bool), np.flatnonzero(self.split > 1)
        opens[flat.ragged(self.base[wide] + 1, self.split[wide] - 1)] = False
        self.parent = np.cumsum(opens) - 1
        self.rows = (int(opens.sum()), rows)
        self.count0 = np.bincount(self.bucket, weights=self.seen, minlength=BUCKETS).astype(np.int64)
        self.count = [np.zeros(r * BUCKETS, np.uint32) for r in self.rows]
        self.cum = [np.zeros(r * WIDE, np.uint16) for r in self.rows]
        self.met = [np.zeros(r, np.uint32) for r in self.rows]  # end of each distribution, as scaled; 0: context not seen
        self.fresh = [np.zeros(r, bool) for r in self.rows]  # contexts counted since the last refresh
        self.mixed = np.zeros(rows * BUCKETS + 1, np.uint16)  # where each bucket of a context of order 2 begins, and the next; 2^16 is 0
        self.weight = np.tile(np.array([1 << SHARE, 0, 0], np.int64), (256, 1))
        self.weight[:, 1:] = (np.arange(256)[:, None] // np.array([16, 1]) % 16) * 100
        self.weight[:, 0] -= self.weight[:, 1:].sum(1)
        self.refresh()

    def refresh(self) -> None:
        """Distributions from the counts so far, and their mixture in each context of order 2."""
        total = 1 << LEVEL
        sums = np.append(0, np.cumsum(self.count0))
        self.cum0 = (sums * total // sums[-1]).astype(np.uint32)
        known = []
        for count, cum, n, fresh in zip(self.count, self.cum, self.met, self.fresh, strict=True):
            c, out, at = count.reshape(-1, BUCKETS), cum.reshape(-1, WIDE), np.flatnonzero(fresh)
            for i in range(0, len(at), ROWS):
                k = at[i : i + ROWS]
                s = np.cumsum(c[k], axis=1, dtype=np.uint32)
                s *= ((1 << 30) // s[:, -1:].astype(np.int64)).astype(np.uint32)
                s >>= np.uint32(30 - LEVEL)
                n[k] = s[:, -1]
                out[k, 1:] = s
            out[at, 0], out[at, -1] = 0, total
            out[n == 0] = self.cum0
            fresh[:] = False
            known.append(np.minimum(15, np.frexp(n.astype(np.float64))[1]).astype(np.int64))
        self.kind = known[0][self.parent] << 4 | known[1]
        # each bucket has 1 at least of a mixture, the weights share the rest
        share = (self.weight * ((1 << SPAN) - BUCKETS) >> SHARE).astype(np.uint32)
        least = share[:, :1] * self.cum0[1:] + (np.arange(1, WIDE, dtype=np.uint32) << np.uint32(LEVEL))
        one, two, out = (m.reshape(-1, w)[:, w - BUCKETS :] for m, w in ((self.cum[0], WIDE), (self.cum[1], WIDE), (self.mixed[1:], BUCKETS)))
        for i in range(0, len(out), ROWS):
            kind = self.kind[i : i + ROWS]
            s = np.multiply(two[i : i + ROWS], share[kind, 2, None], dtype=np.uint32)
            s += np.multiply(one[self.parent[i : i + ROWS]], share[kind, 1, None], dtype=np.uint32)
            s += least[kind]
            np.right_shift(s, np.uint32(LEVEL), out=out[i : i + ROWS], casting="unsafe")
        out[:, -1] = 0
        # places: each id has at least one of the parts of its bucket
        seen = self.seen[self.order]
        sums = np.append(0, np.cumsum(seen))
        begin, held = self.first[self.bucket[self.order]], np.diff(self.first)[self.bucket[self.order]]
        whole = (sums[self.first[1:]] - sums[self.first[:-1]])[self.bucket[self.order]]
        at = (sums[:-1] - sums[begin]) * ((1 << PLACE) - held) // whole + np.arange(len(seen)) - begin
        end = np.append(at[1:], 0)
        end[self.first[1:][np.diff(self.first) > 0] - 1] = 1 << PLACE
        self.place, self.part = np.empty(len(seen), np.uint32), np.empty(len(seen), np.uint32)
        self.place[self.order], self.part[self.order] = at, end - at

    def table(self) -> np.ndarray:
        """The id at each place of each bucket."""
        table = np.zeros(BUCKETS << PLACE, np.int32)
        held = np.repeat(self.order, self.part[self.order])
        table[: len(held)] = held  # buckets are filled from the first on
        return table

    def row(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Contexts of order 2, given the last id and the one before (plus 1; 0: none)."""
        return self.base[p1] + (self.dealt[p2] * self.split[p1] >> 8)

    def contexts(self, p1: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of orders 1 and 2."""
        row = self.row(p1, p2)
        return self.parent[row], row

    def learn(self, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Counts ids and their contexts (last id, the one before), and gives each order the weight it has earned."""
        earned = self.weight * (12 // EACH)
        wide0 = np.diff(self.cum0).astype(np.int64)
        for x, p1, p2 in parts:
            b = self.bucket[x]
            rows = self.contexts(p1, p2)
            kind, own = self.kind[rows[1][::EACH]], b[::EACH]
            q = [wide0[own]]
            for cum, r in zip(self.cum, rows, strict=True):
                at = r[::EACH] * WIDE + own
                q.append(cum[at + 1].astype(np.int64) - cum[at])
            for j in range(3):
                q[j] *= self.weight[kind, j]
            whole = np.maximum(1, q[0] + q[1] + q[2])
            for j in range(3):
                earned[:, j] += np.bincount(kind, weights=(q[j] << 10) // whole, minlength=256).astype(np.int64)
            self.count0 += np.bincount(b, minlength=BUCKETS)
            for count, fresh, r in zip(self.count, self.fresh, rows, strict=True):
                np.add.at(count, r * BUCKETS + b, np.uint32(1))
                fresh[r] = True
            self.seen = self.seen + np.bincount(x, minlength=len(self.seen))
        share = earned * ((1 << SHARE) - 128) // np.maximum(1, earned.sum(1, keepdims=True))
        share[:, 0] = (1 << SHARE) - share[:, 1] - share[:, 2]
        self.weight = share
        self.refresh()


def shape(n: int) -> tuple[int, int, int]:
    """Lanes and steps of a block of ``n`` ids, and the steps of its last lane."""
    steps = max(1, -(-n // max(1, min(LANES, n // STEPS))))
    lanes = -(-n // steps)
    return lanes, steps, n - (lanes - 1) * steps


def segments(steps: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < steps:
        end = at + 2 + at // 2
        end = steps if steps < end + at // 4 else end
        yield at, end
        at = end


def narrow(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose range has become narrow, and whether it must be cut to end before a carry."""
    differ = ((low + span) ^ low) >= TOP
    at = np.flatnonzero(~differ | (span < BOTTOM))
    return at, differ[at]


def cut(low: np.ndarray, span: np.ndarray, under: np.ndarray) -> None:
    if under.any():
        span[under] = (U(0) - low[under]) & (BOTTOM - U(1))


def _before(ids: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(ids)
    out[by:] = ids[: len(ids) - by] + 1
    return out


def alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the place of each id among them, and their counts."""
    if ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    names = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[names] = np.arange(len(names))
    return names, place[ids], counts[names]


def encode_block(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Head and code words of a block of at least one id."""
    names, x, counts = alphabet(ids)
    level = levels(counts)
    lanes, steps, last = shape(len(ids))
    grid = np.zeros(lanes * steps, np.int32)
    grid[: len(ids)] = x
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(level, len(ids))
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    out, start = np.zeros(lanes * (2 * steps + 16), np.uint16), np.arange(lanes) * (2 * steps + 16)
    put = start.copy()
    for a, b in segments(steps):
        if a:
            model.learn(_real(grid, *past, last))
        past = a, b
        for t0 in range(a, b, 16):
            t1 = min(b, t0 + 16)
            c = max(0, t0 - 2)
            seen = grid[c:t1].astype(np.int64)
            part, p1, p2 = (g[t0 - c :].ravel() for g in (seen, _before(seen, 1), _before(seen, 2)))
            at = (model.row(p1, p2) << 8) + model.bucket[part]
            begin = model.mixed[at]
            wide = (model.mixed[at + 1] - begin).astype(np.uint32)
            begin = (begin.astype(np.uint32) << np.uint32(PLACE)) + model.place[part] * wide
            begin, wide = (g.astype(U).reshape(-1, lanes) for g in (begin, wide * model.part[part]))
            for t in range(t0, t1):
                live = lanes if t < last else lanes - 1
                lo, sp = low[:live], span[:live]
                sp >>= U(SPAN + PLACE)
                lo += sp * begin[t - t0, :live]
                sp *= wide[t - t0, :live]
                at, under = narrow(lo, sp)
                while len(at):
                    l, s, p = lo[at], sp[at], put[at]
                    cut(l, s, under)
                    out[p] = l >> U(48)
                    l <<= U(16)
                    s <<= U(16)
                    lo[at], sp[at], put[at] = l, s, p + 1
                    more, under = narrow(l, s)
                    at = at[more]
    # whatever follows the last words, the value lies in the range
    more = 1 + (span < U(1 << 49)) + (span < U(1 << 33))
    low += (U(1) << (U(64) - U(16) * more.astype(U))) - U(1)
    for k in range(3):
        at = np.flatnonzero(more > k)
        out[put[at] + k] = (low[at] >> U(48 - 16 * k)) & U(0xFFFF)
    used = put + more - start
    code = out[flat.ragged(start, used)]
    head = zlib.compress(np.diff(names, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + level.tobytes() + used.astype("<u4").tobytes(), 6)
    return head, code


def _real(grid: np.ndarray, a: int, b: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and contexts of steps a to b, without what pads the last lane, some steps at a time."""
    for t0 in range(a, b, 32):
        t1, c = min(b, t0 + 32), max(0, t0 - 2)
        seen = grid[c:t1].astype(np.int64)
        stay = np.ones((t1 - t0, grid.shape[1]), bool)
        stay[max(0, last - t0) :, -1] = False
        yield tuple(g[t0 - c :][stay] for g in (seen, _before(seen, 1), _before(seen, 2)))


def decode_block(head: bytes, code: np.ndarray, n: int, n_names: int) -> np.ndarray:
    """The block that ``encode_block`` coded."""
    raw = np.frombuffer(zlib.decompress(head), np.uint8)
    names = np.cumsum(np.ascontiguousarray(raw[: 4 * n_names].reshape(4, -1).T).view("<u4").ravel().astype(np.int64))
    level, size = raw[4 * n_names : 5 * n_names], np.frombuffer(raw[5 * n_names :].tobytes(), "<u4").astype(np.int64)
    lanes, steps, last = shape(n)
    if len(size) != lanes or size.sum() != len(code):
        raise ValueError("a block's head differs from its code")
    words = np.append(code, np.zeros(4, np.uint16)).astype(U)
    end = len(words) - 1
    take = np.cumsum(size) - size
    model = Model(level, n)
    grid = np.zeros((steps, lanes), np.int32)
    low, span, value = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U), np.zeros(lanes, U)
    for k in range(4):
        value = (value << U(16)) | words[take + k]
    take += 4
    row, two = np.full(lanes, model.base[0]), np.zeros(lanes, np.int64)
    base, split = model.base[1:], model.split[1:]
    met = np.empty(lanes, np.uint16)
    for a, b in segments(steps):
        if a:
            model.learn(_real(grid, *past, last))
        past, table = (a, b), model.table()
        for t in range(a, b):
            if t == last:  # the last lane has ended
                low, span, value, take, row, two = (g[:-1] for g in (low, span, value, take, row, two))
            span >>= U(SPAN + PLACE)
            v = np.minimum((value - low) // span, U((1 << (SPAN + PLACE)) - 1)).astype(np.uint32)
            aim = (v >> np.uint32(PLACE)).astype(np.uint16)
            at, m = row << 8, met[: len(row)]
            for bit in range(7, -1, -1):
                np.take(model.mixed[1 << bit :], at, out=m, mode="clip")
                at += (m <= aim).view(np.uint8) << np.uint8(bit)
            first = model.mixed[at]
            wide = (model.mixed[at + 1] - first).astype(np.uint32)
            first = first.astype(np.uint32) << np.uint32(PLACE)
            own = at & (BUCKETS - 1)
            x = table[(own << PLACE) + (v - first) // wide].astype(np.int64)
            low += span * (first + model.place[x] * wide)
            span *= wide * model.part[x]
            k, under = narrow(low, span)
            while len(k):
                l, s, p = low[k], span[k], take[k]
                cut(l, s, under)
                l <<= U(16)
                s <<= U(16)
                low[k], span[k], take[k] = l, s, p + 1
                value[k] = (value[k] << U(16)) | words[np.minimum(p, end)]  # a damaged code may ask for more
                more, under = narrow(l, s)
                k = k[more]
            grid[t, : len(x)] = x
            row, two = base[x] + (two * split[x] >> 8), own
    return names[grid.T.ravel()[:n]]
