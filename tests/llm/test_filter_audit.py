"""Filter interactions against a plain run of every order."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import words
from tablemine.llm import filter_audit as A


def _flags(rows):
    """[set of failed filters] of (id, text, source) rows."""
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = words(t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows)
        out.append({f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search("[#$%&*|]", t)), copy)) if bad})
    return out


def _audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, x in labels if x == 1 and d is not None}
    flags, out = _flags(rows), {}
    for part in {s or "" for _, _, s in rows}:
        own = [(d, f) for (d, _, s), f in zip(rows, flags) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own),
                    sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _rows():
    r = random.Random(13)
    kinds = ["plain {} words é", "LOUD {} TEXT", "sign # {}", "few"]
    texts = [None, "", " \n", "x" * 9000, "word " * 5000]
    for i in range(60):
        body = " ".join(r.choice([f"w{k}" for k in range(r.choice((20, 200)))]) for _ in range(r.choice((3, 49, 50, 51, 90))))
        texts.append(r.choice(kinds).format(body))
    texts += [texts[k] for k in r.choices(range(len(texts)), k=40)] + [texts[7]] * 30
    rows = [(i * 3, t, r.choice(("a", "b", "", None))) for i, t in enumerate(texts)]
    r.shuffle(rows)
    # repeated rows, one id with two texts, rows without an id
    return rows + [rows[3], rows[3], (9, texts[7], "a"), (None, texts[7], "b"), (None, None, None)]


def test_equals_every_order(spark, monkeypatch):
    monkeypatch.setattr(A, "COUNTED", 7)
    rows = _rows()
    r = random.Random(5)
    labels = [(d, r.choice((0, 1, None)), r.choice((0, 1, None))) for d in range(0, 200, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id int, text string, source string, mask int, part string")
    names = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in A.filter_interactions(docs, names).collect()}
    assert got == _audit(rows, labels)
    none = A.filter_interactions(docs, names.limit(0))
    assert {x.good_lost for x in none.collect()} == {0}
    assert A.filter_interactions(docs.limit(0), names).count() == 0


@pytest.mark.parametrize("slots", [12, 3 * A.SEGMENT_SLOTS + 999])
def test_sketch_never_clears_a_repeat(spark, slots):
    """However full the sketch, only unique texts are cleared."""
    r = random.Random(1)
    hashes = [r.getrandbits(62) for _ in range(3000)]
    hashes += hashes[:200] + [hashes[500]] * 1000
    df = spark.createDataFrame([(h,) for h in hashes], "h long").repartition(5)
    bits = A.repeat_sketch(df, slots)
    found = A.may_repeat(np.array(hashes, np.int64).view(np.uint64), bits, slots)
    often = np.array([hashes.count(h) > 1 if k < 201 or k > 2990 else h == hashes[500] for k, h in enumerate(hashes)])
    assert found[often].all()
    if slots > A.SEGMENT_SLOTS:
        assert not found[~often].any()


def test_only_possible_repeats_go_on(spark):
    """Unique texts are not sent to the exact grouping."""
    texts = [f"text {k} " * 20 for k in range(2000)] + ["twin"] * 5
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    h = docs.select(F.xxhash64("text"))
    slots = A.slots_for(len(texts))
    found = A.may_repeat(np.array([x[0] for x in h.collect()], np.int64).view(np.uint64), A.repeat_sketch(h, slots), slots)
    assert found[-5:].all() and found.sum() < 60
