"""Weighted fingerprints: rates, edits, and the order of ids."""

import collections
import hashlib
import math
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from brute import words
from tablemine.llm import cws as W


def _similarity(a, b):
    a, b = collections.Counter(words(a)), collections.Counter(words(b))
    top = sum(max(a[k], b[k]) for k in {*a, *b})
    return sum(min(a[k], b[k]) for k in {*a, *b}) / top if top else 1.0


def test_collisions_estimate_similarity(spark):
    r = random.Random(3)
    pairs = []
    for i in range(150):
        pool = [f"w{k}-{i}" for k in range(60)]  # own words, so that the pairs' errors are independent
        a = [r.choice(pool[:r.choice((5, 20, 60))]) for _ in range(r.randint(5, 80))]
        b = [x if r.random() < 0.7 else r.choice(pool) for x in a] + [r.choice(pool) for _ in range(r.randint(0, 40))]
        pairs.append((" ".join(a), " ".join(b)))
    rows = [(i, k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    prints = W.fingerprints(spark.createDataFrame(rows, "i long, k int, text string"), ["i", "k"])
    wide = prints.groupBy("i").pivot("k", [0, 1]).agg(F.first("fingerprint"))
    got = {x.i: x.l for x in wide.select("i", W.likeness("0", "1").alias("l")).collect()}
    off = [got[i] - _similarity(*p) for i, p in enumerate(pairs)]
    assert abs(sum(off) / len(off)) < 0.02
    assert math.sqrt(sum(x * x for x in off) / len(off)) < 1.3 * 0.5 / math.sqrt(W.SAMPLES)


def _hash(first, *more):
    h = xxhash.xxh64_intdigest(first, 42)
    for part in more:
        h = xxhash.xxh64_intdigest(part, h)
    return h


def _plain(text, samples):
    """The samples of a text, one word and one number after the other."""
    out = []
    counts = collections.Counter(words(text))
    for k in range(samples):
        bids = []
        for word, n in counts.items():
            w = struct.pack("<Q", _hash(word.encode()))
            a, b = (_hash(w, struct.pack("<i", 2 * k + i)) for i in (0, 1))
            u = lambda bits, shift, width: ((bits >> shift) % (1 << width) + 0.5) / (1 << width)
            r, beta = -math.log(u(a, 40, 24) * u(a, 16, 24)), u(b, 40, 24)
            c = -math.log(u(b, 20, 20) * u(b, 0, 20))
            t = math.floor(math.log(n) / r + beta)
            value = math.log(c) - r * (t - beta) - r
            bids.append((value, _hash(w, struct.pack("<q", t), struct.pack("<i", k)) % (1 << 31)))
        out.append(f"{min(bids)[1]:08x}")
    return "".join(out)


def test_fingerprints_equal_plain_ones(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["é", "word", "a", "\U0001f600", f"w{r.randint(0, 400)}"]) for _ in range(r.choice((1, 3, 40, 300))))
             for _ in range(60)] + ["\t one\n one ", "x " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {x.i: x.fingerprint for x in W.fingerprints(df, ["i"]).collect()}
    assert got == {i: _plain(t, W.SAMPLES) for i, t in enumerate(texts)}


@pytest.mark.parametrize("ids", [[0], [5, 3], list(range(0, 2000, 2)), [i ** 5 for i in range(900)], [None, 1, 2], [1 << 62, -(1 << 62), 0]])
def test_next_rows(spark, monkeypatch, ids):
    monkeypatch.setattr(W, "RANGE_DOCS", 7)
    monkeypatch.setattr(W, "COARSE", 16)
    df = spark.createDataFrame([(d, f"t{d}", "old") for d in ids], "doc_id long, text string, next string")
    got = {r.doc_id: r.next for r in W.with_next(df, "doc_id", "text").collect()}
    order = sorted(ids, key=lambda d: (d is not None, d or 0))
    assert got == {d: f"t{order[(i + 1) % len(order)]}" for i, d in enumerate(order)}


def test_query(spark, tmp_path):
    texts = [None, "", "é b c d", "one two three four five", "one two three four five", "x", "word " * 4000]
    spark.createDataFrame([(10 * i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in W.op10_weighted_sampling(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        assert got[10 * i].n_chars == len(t)
        assert got[10 * i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if edited == t:
            assert got[10 * i].near_edited == 1.0
    assert got[30].fingerprint == got[40].fingerprint and got[30].near_next == 1.0
    assert got[0].fingerprint == got[10].fingerprint and got[10].near_next == 0.0
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert W.op10_weighted_sampling(spark, f"{tmp_path}/none").count() == 0
