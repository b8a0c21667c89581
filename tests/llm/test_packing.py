"""Packing: whole pieces, full bins, and the plan's bounds."""

import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tablemine.llm import packing as K
from tablemine.llm.bpe import vocabulary_path


def _bins(plan):
    out = []
    for times, content in plan:
        out += [[n for n, k in content for _ in range(k)]] * times
    return out


def test_plan_uses_all_and_fits():
    r = random.Random(3)
    for _ in range(60):
        capacity = r.choice((10, 64, 2048))
        counts = Counter(min(capacity, max(1, int(r.expovariate(1 / r.choice((3, 200, 1500)))))) for _ in range(r.choice((1, 30, 2000))))
        plan = K.best_two_fit(dict(counts), capacity)
        bins = _bins(plan)
        assert Counter(x for b in bins for x in b) == counts
        assert all(sum(b) <= capacity for b in bins)
        assert len(plan) <= len(counts) * 2 + 1
        least = -(-sum(n * c for n, c in counts.items()) // capacity)
        assert len(bins) <= least * 11 / 9 + 1
    assert K.best_two_fit({}) == []


def _one_bin(pieces, capacity):
    """The next bin of plain best-two-fit over single pieces."""
    left = sorted(pieces, reverse=True)
    taken, gap = [], capacity
    for n in list(left):
        if n <= gap:
            taken.append(n)
            left.remove(n)
            gap -= n
    if gap:
        small = min(taken)
        room, best = gap + small, (small, None)
        free = sorted([*left, small])
        for i, a in enumerate(free):
            for b in free[:i]:
                if best[0] < a + b <= room:
                    best = (a + b, (a, b))
        if best[1]:
            taken.remove(small)
            taken += best[1]
    return taken


def test_each_pattern_is_the_plain_next_bin():
    r = random.Random(8)
    for _ in range(60):
        capacity = r.choice((10, 30, 100))
        pieces = [r.randint(1, r.choice((capacity, max(1, capacity // 3)))) for _ in range(r.choice((1, 12, 60)))]
        rest = Counter(pieces)
        plain_bins, plain_rest = 0, Counter(pieces)
        while plain_rest:
            plain_rest -= Counter(_one_bin(plain_rest.elements(), capacity))
            plain_bins += 1
        plan = K.best_two_fit(dict(rest), capacity)
        for times, content in plan:
            # two pairs may fill a bin alike
            plain = _one_bin(rest.elements(), capacity)
            assert sum(plain) == sum(n * k for n, k in content)
            for n, k in content:
                rest[n] -= k * times
            rest = +rest
        assert not rest
        # a pattern is used again while its pieces last
        assert abs(sum(times for times, _ in plan) - plain_bins) <= 1


def test_two_replace_the_smallest():
    # greedy: 6 + 3 leaves 1; 2 + 2 in place of 3 fill the bin
    assert _bins(K.best_two_fit({6: 1, 3: 1, 2: 2}, 10))[0] == [6, 2, 2]


def test_pieces_and_places(spark):
    library = Tokenizer.from_file(vocabulary_path())
    texts = [None, "", "one", "one", "word " * 5000, "a b " * 1024 + "c"] + [f"text number {i} " * (i % 90) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = K.pack(K.token_pieces(docs)).collect()
    want = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            want.append((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 2048
    assert len(by) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_one_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKET_PIECES", 10)
    docs = spark.createDataFrame([(i % 50, "the same text") for i in range(400)], "doc_id long, text string")
    rows = K.pack(K.token_pieces(docs)).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 400
    assert len({r.sequence_id for r in rows}) == 1


def test_empty_table(spark):
    assert K.pack(K.token_pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
