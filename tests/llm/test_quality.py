"""Quality rules against plain versions of the counts and distances."""

import random

from brute import base_quality, quality
from tablemine.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, kept string"


def _rows():
    r = random.Random(2)
    prose = lambda n: " ".join(r.choice("the of and to in that word river stone light under paper".split()) for _ in range(n)) + "."
    odd = lambda n: " ".join(r.choice("THE OF STONE".split()) + "!!" for _ in range(n))
    fr = lambda n: " ".join(r.choice("de la les dans été où maison arbre".split()) for _ in range(n))
    texts = [(prose(150), "en") for _ in range(12)] + [(fr(150), "fr") for _ in range(6)] + [(odd(200), "en") for _ in range(4)]
    texts += [(None, "en"), ("", None), ("   \n\t", "xx"), ("short text", "en"), (prose(25), None), ("a b c d e f g h " * 20, "en"),
              ("line one\nline one\n\nline two # $ %\nline one " + prose(30), "de"), ("x" * 50_000, "en"), (prose(20_000), "en"),
              ("été \x1cñ " * 40, "zz"), (prose(150), "fr")]
    texts += [texts[0]] * 3
    return [(i % 30, t, g, "old") for i, (t, g) in enumerate(texts)]


def test_counts_and_verdicts(spark):
    rows = _rows()
    got = Q.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    want = quality([r[:3] for r in rows])
    have = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept,
                   round(r.class_distance, 6), round(r.word_distance, 6)) for r in got)
    need = sorted((d, *base_quality(t).values(), k, round(a, 6), round(b, 6)) for (d, t, *_), (k, a, b) in zip(rows, want))
    assert have == need
    assert {r.kept for r in got} == {True, False}


def test_kept_rows_keep_their_columns(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(r for r, (k, *_) in zip(rows, quality([r[:3] for r in rows])) if k)
    assert sorted(map(tuple, kept.collect())) == want


def test_no_reference_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "word " * 3 + "different words all over this text so it has no repeats but is long enough to pass "
                                   "the twenty", None, "x")], SCHEMA)
    assert [r.kept for r in Q.quality_rules(docs).collect()] == [True]
    assert Q.quality_rules(docs.limit(0)).count() == 0
    assert Q.quality_rules(docs.drop("lang", "kept")).count() == 1
