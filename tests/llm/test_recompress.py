"""Removal of repeated passages against a list of all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from brute import without_repeats
from tablemine.llm import recompress as R
from tablemine.llm.common import Words


def _texts(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = [[r.choice(vocabulary) for _ in range(r.choice((34, 35, 36, 60)))] for _ in range(5)]
    texts = [None, "", "  \n ", "one", "run " * 34, "run " * 36, "run " * 100, "ab cd " * 40, "x" * 5000]
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice((0, 10, 50, 300)))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passage)
        texts.append(r.choice((" ", "\n", " \t ")).join(w))
    return texts + [texts[20], texts[20], "Tail " + (texts[21] or "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, seed):
    texts = _texts(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, chunk int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in R.remove_repeats(docs).collect()}
    assert got == {i: (n, m, " ".join(k)) for i, (n, m, k) in enumerate(without_repeats(texts))}
    assert any(m for _, m, _ in got.values()) and any(n and not m for n, m, _ in got.values())


def test_rows_in_another_order_at_each_reading(spark, monkeypatch):
    """Each of the three readings gets its rows in an order of its own, as
    from executors that answer at different times."""
    monkeypatch.setattr(R, "LEAST", 2)
    texts = _texts(5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def shuffled(batches):
        r = np.random.Generator(np.random.PCG64())
        for batch in batches:
            yield batch.take(pa.array(r.permutation(batch.num_rows)))

    docs = docs.coalesce(1).mapInArrow(shuffled, docs.schema)
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in R.remove_repeats(docs).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    assert got == {i: (n, m, " ".join(k)) for i, (n, m, k) in enumerate(without_repeats(texts))}


def test_chunks_hold_a_budget_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(R, "LEAST", 1)
    monkeypatch.setattr(R, "CHUNK_BYTES", 2000)
    texts = _texts(6)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in R.remove_repeats(docs).collect()}
    assert got == {i: m for i, (_, m, _) in enumerate(without_repeats(texts))}


def test_one_row_many_times(spark, monkeypatch):
    """Equal rows travel as one with a count: the same result."""
    monkeypatch.setattr(R, "CHUNK_DOCS", 5)
    texts = _texts(7)
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, texts[-1])] * 40 + [(98, texts[30])] * 2 + [(None, None)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in R.remove_repeats(docs).collect()), key=repr)
    want = [(d, n, m, " ".join(k)) for (d, _), (n, m, k) in zip(rows, without_repeats([t for _, t in rows]))]
    assert got == sorted(want, key=repr)


def test_rows_that_repeat_wholly(spark):
    text = " ".join(f"t{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text)] * 3 + [(None, text), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in R.remove_repeats(docs).collect()), key=repr)
    assert got == sorted([(1, 50, 50, "")] * 3 + [(None, 50, 50, ""), (2, 0, 0, "")], key=repr)
    assert R.remove_repeats(docs.limit(0)).count() == 0


def test_contexts_force_symbols():
    """A window that holds a symbol's context gives that symbol wherever it stands."""
    r = np.random.Generator(np.random.PCG64(3))
    inner = r.integers(0, 4, 60).astype(np.uint64) + np.uint64(7)
    for rounds in (1, 3, 6):
        seen = []
        for _ in range(8):
            ids = np.concatenate([r.integers(0, 4, 9), inner - np.uint64(7), r.integers(0, 4, 9)]).astype(np.uint64) + np.uint64(7)
            name, lo, hi = R.recompress(ids, np.array([0, len(ids)]), rounds)
            own = (lo >= 9) & (hi <= 69)
            seen.append(sorted(zip(lo[own].tolist(), hi[own].tolist(), name[own].tolist())))
        assert all(x == seen[0] for x in seen) and seen[0]


def test_window_hashes_name_windows():
    words = Words(pa.array(["a b c d e f g", "b c d e f g h"]))
    for width in (1, 2, 3, 5, 7):
        h = R.windows_of(words.ids, width, 0x9E3779B97F4A7C15)
        assert len(h) == len(words.ids) - width + 1
        if width < 7:
            assert h[1] == h[7]
