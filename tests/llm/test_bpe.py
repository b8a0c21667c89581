"""BPE with the minimal acyclic lexicon, against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablemine.llm import bpe

PATH = bpe.vocabulary_path()
HARD = ["", " ", "\n\t", "a" * 3000, "ab" * 2000 + " x", "<|startoftext|><|endoftext|>a<|endoftext|", "it's I'LL don't",
        "İstanbul ΑΣ Σ ß", "word x", "éa ́x", "中文 12²½ \U0001F600", "x\x00y\x1cz\x85w", "HELLO!!! ###", "çéüñ ªº"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _encode(enc, texts):
    ids, starts = enc.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]


def _random_texts(n):
    r = random.Random(4)
    alphabet = "abcDEé  '’\n<|endoftext|>1²-!İσ́"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_ids_equal_the_library(library):
    texts = HARD + _random_texts(800)
    got = _encode(bpe.Encoder(PATH), texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_lexicon_changes_no_result(tmp_path, library):
    texts = HARD + _random_texts(300)
    v = bpe.Vocabulary(PATH)
    words = sorted({w for t in texts for p in v.pieces(t.encode().split()) for w in p if isinstance(w, bytes)})[::2]
    bpe.Lexicon.write(words, v.merge(words), str(tmp_path / "lexicon"))
    enc = bpe.Encoder(PATH, str(tmp_path / "lexicon"))
    found = enc.lexicon.find([*words, b"not-in-it", b"", b"x" * 500])
    assert found[:-3] == v.merge(words) and found[-3:] == [None, None, None]
    assert _encode(enc, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_automaton_is_minimal():
    words = sorted({a + b for a in (b"re", b"un", b"out") for b in (b"ing", b"ed", b"s")})
    a = bpe.build_automaton(words)
    right = {}
    edges = {}
    for k, t in zip(a["key"].tolist(), a["target"].tolist()):
        edges.setdefault(k >> 8, []).append((k & 255, t))

    def language(s):
        if s not in right:
            right[s] = frozenset([b""] if a["final"][s] else []) | {bytes([c]) + w for c, t in edges.get(s, ()) for w in language(t)}
        return right[s]

    assert language(0) == set(words)
    assert len(set(map(language, range(len(a["final"]))))) == len(a["final"])


def test_empty_lexicon(tmp_path):
    bpe.Lexicon.write([], [], str(tmp_path / "none"))
    assert bpe.Lexicon(str(tmp_path / "none")).find([b"a"]) == [None]


def test_long_words_merge_like_short_ones(monkeypatch, library):
    word = "internationalisation" * 4
    whole = bpe.Encoder(PATH).vocabulary.merge([word.encode()])
    monkeypatch.setattr(bpe, "ARRAY_BYTES", 0)
    assert bpe.Encoder(PATH).vocabulary.merge([word.encode()]) == whole
    assert np.frombuffer(whole[0], "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_round_trip_digests(spark, library):
    texts = [None, "", "Hello World", "Hello World", *HARD[3:8]]
    docs = spark.createDataFrame([(i, t, "n", i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids long")
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, bpe.build_lexicon(docs, size=5)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.decode(bpe.encode(docs))
    assert [x.decoded for x in coded.orderBy("doc_id").collect()] == [
        library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]
    assert bpe.round_trip_digests(docs.limit(0), bpe.build_lexicon(docs.limit(0))).count() == 0
