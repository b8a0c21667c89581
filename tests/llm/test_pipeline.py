"""The whole pipeline against plain versions of its stages."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from brute import groups, quality, without_repeats
from tablemine.llm import pii
from tablemine.llm.bpe import vocabulary_path


def _documents():
    r = random.Random(8)
    en = "the of and to in that word river stone light under paper lamp green hill".split()
    prose = lambda n: " ".join(r.choice(en) + r.choice(("", "", ",", "a", "o", "ing", "er")) for _ in range(n))
    shared = prose(60)
    texts = [prose(r.randint(120, 300)) for _ in range(30)]
    texts += [prose(150) + " " + shared + " " + prose(100) for _ in range(4)]
    for t in texts[:6]:
        w = t.split()
        w[7] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[1], "THE!! OF!! " * 60, "same words again " * 50, "short", None, ""]
    texts += [prose(100) + " mail bob.a@site.example.org " + prose(60), prose(150) + " password=5f367f08b1a810c7777a " + prose(30)]
    return [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]


def test_run_equals_plain_stages(spark, tmp_path):
    rows = _documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = [r[:3] for r in rows]
    docs = [d for d, (k, *_) in zip(docs, quality(docs)) if k]
    assert 30 <= len(docs) < len(rows)
    docs = [d for d, (_, c) in zip(docs, groups([d[:2] for d in docs])) if c == d[0]]
    cut = without_repeats([t for _, t, _ in docs])
    assert any(m for _, m, _ in cut)
    docs = [(d, " ".join(k) if m else t) for (d, t, _), (_, m, k) in zip(docs, cut)]
    field = pii.fitted()
    clean = []
    for d, t in docs:
        base = pii.base_spans(t)
        clean.append((d, pii.redacted(t, base + pii.added_spans(t, base, field))))
    assert any("<EMAIL>" in t for _, t in clean) and any("<SECRET>" in t for _, t in clean)
    library = Tokenizer.from_file(vocabulary_path())
    want = []
    for d, t in clean:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            want.append((d, p, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 2048


def test_stages_keep_columns_and_take_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near copies", "repeated passages", "personal data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.packing(spark, empty, "").count() == 0


def test_near_copies_of_repeated_and_missing_ids(spark):
    text = "a passage of some words that stands here more than once in this table of rows"
    rows = [(4, text, "en", "s", 1), (4, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 2]
