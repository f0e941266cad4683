"""Banded and semi-global alignment with bit-parallel columns (Myers; Hyyro) on Python integers."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def banded_distance(a: Sequence[Hashable], b: Sequence[Hashable], limit: int) -> int:
    """Edit distance of ``a`` and ``b`` if it is at most ``limit``, else ``limit + 1``.

    Only cells within ``limit`` of the main diagonal are kept: each column is one integer of 2 * limit + 1 bits
    that slides down one row a step.
    """
    begin = 0
    short = min(len(a), len(b))
    while begin < short and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < short - begin and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > limit:
        return limit + 1
    if not m:
        return n
    limit = min(limit, n)
    width = 2 * limit + 2
    full, corner, row = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    where: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    # in column j (from 0) the highest bit stands for row j + limit; rows under 0 never match
    vp, vn, score = (full << (width - limit - 1)) & full, 0, limit
    for j, x in enumerate(b):
        shift = j + limit + 1 - width
        found = where.get(x, 0)
        match = ((found >> shift) if shift >= 0 else (found << -shift)) & full
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < n - limit:  # the lowest cell of the band moves along its diagonal
            score += not d0 & corner
        else:  # and from the last row on, along that row
            score += bool(hp & row) - bool(hn & row)
            row >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
        if score - (min(n, j + 1 + limit) - 1 - j + limit) > limit:
            return limit + 1
    return min(score, limit + 1)


def find_approximate(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Best occurrence of ``pattern`` in ``text`` with at most ``limit`` edits: (distance, end), the leftmost of the best."""
    m = len(pattern)
    if not m:
        return (0, 0)
    where: dict[str, int] = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, None
    for j, x in enumerate(text, 1):
        eq = where.get(x, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp = (hn | ~(d0 | hp)) & full
        vn = d0 & hp
        if score <= limit and (best is None or score < best[0]):
            best = (score, j)
    return best
