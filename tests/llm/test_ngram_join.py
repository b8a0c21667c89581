"""The similarity join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import groups, shingles
from tablemine.llm import ngram_join as J


def _corpus(seed, families=6, copies=14):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = [r.choice(vocabulary) for _ in range(12)]
    rows, i = [], 0
    for _ in range(families):
        first = [r.choice(vocabulary) for _ in range(r.choice((6, 40, 90, 200)))]
        for _ in range(copies):
            w = list(first)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w += common
            rows.append((i, " ".join(x.upper() if r.random() < 0.2 else x for x in w)))
            i += 1
    rows += [(i + k, t) for k, t in enumerate(
        [None, "", " \n", "one", "ONE", "one two", "two one", "a b c d e", "A  b\tc\nd e", "a b c d", rows[0][1], rows[0][1], "x " * 4000])]
    r.shuffle(rows)
    return rows


def _check(spark, rows):
    df = spark.createDataFrame([(d, t, 0, "c") for d, t in rows], "doc_id long, text string, size int, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similar_groups(df).collect()), key=repr)
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, groups(rows))), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_all_pairs(spark, seed):
    _check(spark, _corpus(seed))


def test_blocks_of_large_cells(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL_DOCS", 4)
    _check(spark, _corpus(3, families=4, copies=20))


def test_tasks_of_a_hot_passage_are_bounded(spark, monkeypatch):
    """Many short documents that are half one passage and not similar, with near copies among them."""
    r = random.Random(8)
    passage = [f"hot{k}" for k in range(20)]
    rows = []
    for i in range(0, 600, 2):
        own = [f"w{r.randrange(10**6)}" for _ in range(20)]
        rows.append((i, " ".join(passage + own)))
        if i % 20 == 0:
            rows.append((i + 1, " ".join(passage + own[:19] + ["edited"])))
    inner = J.links_of

    def bounded(table):
        assert table.num_rows <= 96, table.num_rows
        return inner(table)

    monkeypatch.setattr(J, "CELL_DOCS", 16)
    monkeypatch.setattr(J, "links_of", bounded)
    _check(spark, rows)


def test_repeated_and_missing_ids(spark):
    text = "the same long passage of words stands in this row and in that one too"
    _check(spark, [(5, text), (5, text), (5, "another text with the id five that is not alike at all"), (2, text),
                   (None, text), (None, None), (9, "another text with the id five that is not alike at all")])


def test_threshold_is_exact(spark):
    # 15 of 20 shingles shared links; 14 of 19 does not
    base = [f"a{k}" for k in range(21)]
    near = base[:19] + ["z", "y", "x"][:0]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:16] + ["q"] * 1))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 100 * len(a & b) >= 75 * len(a | b)
    _check(spark, rows)


def test_tree_loses_no_link():
    r = np.random.Generator(np.random.PCG64(5))
    pool = r.integers(0, 2**63, 5000, np.uint64)
    sets = []
    for _ in range(40):
        first = r.choice(pool, r.integers(1, 200), replace=False)
        for _ in range(5):
            keep = first[r.random(len(first)) > 0.08]
            sets.append(np.unique(np.concatenate([keep, r.choice(pool, 3)])))
    tree = J.CountTree(sets)
    for k in range(len(sets)):
        near = set(tree.near(k).tolist())
        assert {j for j in range(len(sets)) if tree.linked(k, j)} <= near
        assert k in near


def test_empty_and_lonely(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.similar_groups(empty).count() == 0
    one = spark.createDataFrame([(7, "only one text here")], "doc_id long, text string")
    assert [tuple(r) for r in J.similar_groups(one).collect()] == [(7, 1, 7)]


def test_components_of_a_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in J.components(links).collect()} == {0}
