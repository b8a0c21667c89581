"""Divergence of sources against listing every cell in whole numbers."""

import collections
import random
import re

import numpy as np
import pytest

from tablemine.llm import source_audit as S

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _share(c, n, v):
    return 1 + 10**9 * (c + 2) // (n + 2 * v)


def _audit(rows, least=10, top=10):
    out = set()
    rows = [(t, a or "", b or "") for t, a, b in rows]
    for lang in {a for _, a, _ in rows}:
        own = [(_terms(t), b) for t, a, b in rows if a == lang]
        df = collections.Counter(x for t, _ in own for x in set(t))
        kept = {x for x, n in df.items() if n >= least}
        count = {b: collections.Counter() for _, b in own}
        for t, b in own:
            count[b].update(x for x in t if x in kept)
        whole = sum(count.values(), collections.Counter())
        v = len(kept)
        p = {b: {x: _share(c[x], sum(c.values()), v) for x in kept} for b, c in count.items()}
        q = {x: _share(whole[x], sum(whole.values()), v) for x in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for b in count:
            parts = {"pair": [(sum(f(p[b][x], p[o][x]) for x in kept), o) for o in count if o != b],
                     "term": [(f(p[b][x], q[x]), x) for x in kept if count[b][x] and p[b][x] > q[x]]}
            for part, found in parts.items():
                found.sort(key=lambda z: (-z[0], z[1].encode()))
                out |= {(lang, b, part, o, n, k) for k, (n, o) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


def _rows(seed, sources=7):
    r = random.Random(seed)
    pool = [f"w{''.join(r.choice('abcé') for _ in range(3))}" for _ in range(60)] + ["The", "THE", "日本", "x\x00y", "a_b", "É"]
    rows = [(None, "en", "s1"), ("", "en", None), ("word " * 3000, "de", "s0"), (None, None, None), ("x " * 40, "zz", "only")]
    for _ in range(150):
        n = r.choice((0, 3, 40))
        rows.append((r.choice((" ", "\n", "1", "-")).join(r.choices(pool, k=n)), r.choice(("en", "en", "de", None)),
                     r.choice([None, *(f"s{k}" for k in range(sources))])))
    return rows + [rows[20]] * 12 + [(None, "en", "empty"), ("rare", "de", "empty")]


@pytest.mark.parametrize("seed, tile, block, frontier", [(1, 256, 4096, 1 << 20), (2, 3, 7, 50), (3, 2, 64, 9)])
def test_equals_all_cells(spark, monkeypatch, seed, tile, block, frontier):
    monkeypatch.setattr(S, "TILE_GROUPS", tile)
    monkeypatch.setattr(S, "BLOCK_TERMS", block)
    rows = _rows(seed)
    docs = spark.createDataFrame([(i, *x, "old", 1) for i, x in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, term string, n int")
    got = {tuple(x) for x in S.source_divergence(docs).collect()}
    assert got == _audit(rows)
    if seed == 1:
        assert S.source_divergence(docs.limit(0)).count() == 0
        none = S.source_divergence(docs, min_docs=10**6).collect()
        assert none and {(x.part, x.value) for x in none} == {("pair", 0)}


@pytest.mark.parametrize("n, m, density, limit", [(1, 1, 1.0, 1 << 20), (5, 33, 0.2, 7), (20, 100, 0.02, 64), (9, 16, 0.0, 5), (3, 8, 1.0, 4)])
def test_walk_prices_empty_quadrants(monkeypatch, n, m, density, limit):
    monkeypatch.setattr(S, "FRONTIER", limit)
    r = np.random.Generator(np.random.PCG64(n))
    dense = np.where(r.random((n, m)) < density, r.integers(1, 50, (n, m)), 0)
    row, col = np.nonzero(dense)
    totals = dense.sum(1) + 2 * m + r.integers(0, 9, n)
    p = S.shares(dense + 2, np.broadcast_to(totals[:, None], dense.shape))
    want = S.gap(p[:, None, :], p[None, :, :]).sum(2)
    all_rows = np.arange(n)
    got = S.walk(row, col, dense[row, col], totals, all_rows, all_rows, m)
    assert (got == want).all()
    half = all_rows[: n // 2]
    assert (S.walk(row, col, dense[row, col], totals, half, all_rows[n // 2:], m) == want[: n // 2, n // 2:]).all()


def test_shares_are_exact():
    count = np.array([2, 3, 10**12, 7 * 10**15 - 1, 5], np.int64)
    total = np.array([7, 3, 3 * 10**12 + 1, 7 * 10**15, 6 * 10**15], np.int64)
    assert S.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]
