"""Non-negative positive-unlabelled learning: risk, accuracy, odd input."""

import random
import zlib

import numpy as np
import pyarrow as pa

from tablemine.llm import toxicity as T

POOL = ["harbour", "window", "morning", "paper", "garden", "river", "table", "yellow", "music", "letter", "été", "größe"]
FOUL = ["vile", "wretchling", "scoundrelish", "blackguardly"]


def _docs(n, seed=4):
    """Generated texts, a fifth of them foul; half of all labelled."""
    r = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        w = [r.choice(POOL) + r.choice(["", "s", "ly", "er"]) for _ in range(r.randint(5, 60))]
        truth[i] = r.random() < 0.2
        if truth[i]:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(FOUL).title())
        docs.append((i, ". ".join(w), "x", "y"))
        if r.random() < 0.5:
            labels.append((i, int(truth[i])))
    return docs, labels, truth


def test_held_out_accuracy(spark):
    docs, labels, truth = _docs(1500)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, lang string")
    names = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score_toxicity(df, names).collect()}
    assert len(got) == len(docs)
    for i in got:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) > 0.97 * len(held)
    # labels of the held-out fold change nothing
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels],
                                   "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in T.score_toxicity(df, turned).collect()}
    assert all(again[i] == got[i].score for i in got)


def test_odd_input(spark):
    docs, labels, _ = _docs(200)
    rows = [(None, "vile vile", "s"), (1000, None, "s"), (1001, "", "s"), (1002, "é" * 50_000, "s"), (1003, "window " * 20_000, "s"),
            (1004, "1234 ... \n", "s")] + [(7, docs[7][1], "s")] * 2
    df = spark.createDataFrame([d[:2] + ("s",) for d in docs] + rows, "doc_id long, text string, held_out string")
    names = spark.createDataFrame(labels + [(None, 1), (3, None)] + labels[:5], "doc_id long, toxic int")
    got = T.score_toxicity(df, names).collect()
    assert len(got) == len(docs) + len(rows)
    score = {r.doc_id: r.score for r in got}
    assert score[1000] == score[1001] == score[1004]
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert {r.score for r in T.score_toxicity(df, names.where("toxic = 0")).collect()} == {0.0}
    assert T.score_toxicity(df.limit(0), names).count() == 0


def test_risk_is_the_corrected_one():
    r = np.random.Generator(np.random.PCG64(2))
    p, u = r.normal(1, 2, 50), r.normal(-1, 2, 400)
    wrong, harmless = T.risk(0.3, p, u)
    plain = lambda x: np.log(1 + np.exp(x))
    assert np.isclose(wrong, 0.3 * np.mean(plain(-p))) and np.isclose(harmless, np.mean(plain(u)) - 0.3 * np.mean(plain(p)))


def test_steps_turn_where_the_estimate_is_negative():
    """With features that name single toxic documents plain risk runs below
    zero; the non-negative one keeps the estimate near it."""
    toxic = [np.array([k], np.int32) for k in range(60)]
    rest = [np.array([1000], np.int32)] * 200
    kept = np.arange(60)
    w, b = T._descend(T.Sample(toxic, kept), T.Sample(rest, kept), 0.5, 60)
    _, harmless = T.risk(0.5, w[:60] + b, np.full(200, b))
    assert harmless > -0.2


def test_features_are_words_and_beginnings():
    texts = pa.array(["Loathsome!", "loath-some", "loathsome LOATHSOME", None, "a b"])
    found, starts = T.features(texts)
    sets = [set(found[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:])]
    assert sets[0] == sets[2] and len(sets[0]) == 1 + len(T.BEGINNINGS)
    assert len(sets[0] & sets[1]) == 2 and not sets[3] and len(sets[4]) == 2
