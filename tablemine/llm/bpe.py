"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words are encoded once and compiled into a minimal acyclic automaton
(words that end alike share their suffix states).  Every arc carries how many
words its state passes over, so a walk sums up to the word's number, and that
number points at the word's ids.  The arrays go to the executors as one file,
which each Python worker maps into memory.  Words that the automaton does not
know are merged exactly, by the vocabulary's merge ranks.

The lexicon only saves work: its size (``LEXICON_WORDS``) changes no result.
Only the tokenizer file's model (vocabulary, merges) is used; for texts with
characters beyond Latin-1 its normaliser and word splitter are called on the
affected word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, as_bytes, checkpointed, extended, read, slices

VOCABULARY = "word_bpe_49k.json"
#: Words of the automaton: it is built on the driver and mapped by every
#: worker, so it has a bound; all other words are merged.
LEXICON_WORDS = 32_768
#: Words a worker keeps with their ids before it starts anew (40 to 50 bytes each).
CACHE_WORDS = 2_000_000
#: Distinct words that a task counts before it sends them.
COUNTED_WORDS = 200_000
#: Longest word (bytes) that goes through the array merge; longer ones are
#: merged one by one with a heap.
ARRAY_BYTES = 40
#: Words merged together.
MERGE_ROWS = 4096

_SAFE = re.compile(r"[\n!-~\xa1-\xac\xae-\xff]*", re.ASCII)
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids = data["model"]["vocab"]
        self.path, self.suffix = path, data["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.base = len(self.tokens)
        letters = _byte_letters()
        self.letter_byte = {c: b for b, c in letters.items()}
        self.inner = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([ids[letters[b] + self.suffix] for b in range(256)], np.int64)
        pairs = [(ids[a] * self.base + ids[b], r, ids[a + b])
                 for r, (a, b) in enumerate(data["model"]["merges"])]
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs], np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs], np.int32)
        self.merged_by_rank = np.zeros(len(pairs), np.int64)
        for _, r, new in pairs:
            self.merged_by_rank[r] = new
        self._normal = None

    # -- words of a text ------------------------------------------------

    def pieces(self, chunks: list[bytes]) -> list[list[bytes | int]]:
        """Words (lower-cased UTF-8) or special ids of runs of text without
        ASCII white space."""
        joined = b"\n".join(chunks).decode("utf-8", "replace")
        if any(s in joined for s in self.special) or not _SAFE.fullmatch(joined):
            return [self._pieces_any(c) for c in joined.split("\n")]
        find = _PIECES.findall
        return [[w.encode()] if w.isalpha() else [p.encode() for p in find(w)]
                for w in joined.lower().split("\n")] if chunks else []

    def _pieces_any(self, text: str) -> list[bytes | int]:
        out: list[bytes | int] = []
        for part in self._split_special(text):
            if isinstance(part, int):
                out.append(part)
            elif _SAFE.fullmatch(part):
                out += [p.encode() for p in _PIECES.findall(part.lower())]
            else:
                out += self._library_pieces(part)
        return out

    def _split_special(self, text: str) -> list[str | int]:
        if not any(s in text for s in self.special):
            return [text]
        cut = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return [self.special.get(p, p) for p in cut if p]

    def _library_pieces(self, text: str) -> list[bytes]:
        if self._normal is None:
            from tokenizers import Tokenizer
            t = Tokenizer.from_file(self.path)
            self._normal = (t.normalizer, t.pre_tokenizer)
        normal, words = self._normal
        back = self.letter_byte
        return [bytes(back[c] for c in w) for w, _ in words.pre_tokenize_str(normal.normalize_str(text))]

    # -- exact merging --------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; the number of merges where there is none."""
        key = a * self.base + b
        at = np.searchsorted(self.pair_keys, key)
        np.minimum(at, len(self.pair_keys) - 1, out=at)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.pair_ranks))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32 bit) of each word."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cut = int(np.searchsorted(sizes[order], ARRAY_BYTES, "right"))
        for i in order[cut:].tolist():
            out[i] = self._merge_long(words[i])
        for a in range(0, cut, MERGE_ROWS):
            part = order[a:min(cut, a + MERGE_ROWS)]
            for i, x in zip(part.tolist(), self._merge_block([words[i] for i in part.tolist()], sizes[part])):
                out[i] = x
        return out

    def _merge_block(self, words: list[bytes], size: np.ndarray) -> list[bytes]:
        """Words of about one length, all merged together: each round replaces
        every word's lowest, leftmost pair."""
        width, n, none = int(size.max()), len(words), len(self.pair_ranks)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        row = np.arange(n)
        ids = self.inner[raw].astype(np.int32)
        ids[row, size - 1] = self.final[raw[row, size - 1]]
        ids[np.arange(width) >= size[:, None]] = -1
        rank = np.full((n, width), none, np.int32)
        if width > 1:
            rank[:, :-1] = self._ranks(ids[:, :-1].astype(np.int64), ids[:, 1:])
            rank[:, :-1][ids[:, 1:] < 0] = none
        done = np.full((n, width), -1, np.int32)
        cols, own = np.arange(width), row
        while len(own):
            k = np.arange(len(own))
            at = rank.argmin(1)
            low = rank[k, at]
            go = low < none
            if not go.all():
                done[own[~go]] = ids[~go]
                own, ids, rank, at, low = own[go], ids[go], rank[go], at[go], low[go]
                k = np.arange(len(own))
                if not len(own):
                    break
            # the pair becomes one symbol; what stands right of it moves left
            moves = cols[:-1] > at[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:], where=moves)
            np.copyto(rank[:, :-1], rank[:, 1:], where=moves)
            ids[:, -1], rank[:, -1] = -1, none
            new = self.merged_by_rank[low]
            ids[k, at] = new
            right = ids[k, np.minimum(at + 1, width - 1)]
            rank[k, at] = np.where((right >= 0) & (at + 1 < width), self._ranks(new, right), none)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1].astype(np.int64), new[left])
        size = (done >= 0).sum(1)
        flat = done[done >= 0].astype("<u4").tobytes()
        ends = (np.cumsum(size) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _merge_long(self, word: bytes) -> bytes:
        """One word of any length: lowest rank first, leftmost on ties."""
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        n, none = len(ids), len(self.pair_ranks)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist() if n > 1 else []
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < none]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i: int) -> None:
            j = nxt[i]
            if j < n:
                key = ids[i] * self.base + ids[j]
                at = int(np.searchsorted(self.pair_keys, key))
                if at < len(self.pair_keys) and self.pair_keys[at] == key:
                    heapq.heappush(heap, (int(self.pair_ranks[at]), i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = int(self.merged_by_rank[r])
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return np.array([x for x, ok in zip(ids, alive) if ok], "<u4").tobytes()


# -- the lexicon ----------------------------------------------------------

def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of ``words`` (sorted, distinct), made word by
    word: states after the common prefix with the next word are final and are
    replaced by an equal state if one was registered."""
    arcs: list[list[list[int]]] = [[]]
    accept = [False]
    register: dict[tuple, int] = {}
    below: dict[int, int] = {}  # words that end at or under a settled state
    path: list[int] = [0]

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            s = path.pop()
            below[s] = accept[s] + sum(below[t] for _, t in arcs[s])
            same = register.setdefault((accept[s], tuple((c, t) for c, t in arcs[s])), s)
            arcs[path[-1]][-1][1] = same

    last = b""
    for w in words:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        settle(k)
        for c in w[k:]:
            arcs.append([])
            accept.append(False)
            arcs[path[-1]].append([c, len(arcs) - 1])
            path.append(len(arcs) - 1)
        accept[path[-1]] = True
        last = w
    settle(0)
    number: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack.pop()
        if s not in number:
            number[s] = len(number)
            stack += [t for _, t in arcs[s]]
    rows = []
    for s, i in number.items():
        skip = int(accept[s])
        for c, t in arcs[s]:
            rows.append((i * 256 + c, number[t], skip))
            skip += below[t]
    rows.sort()
    final = np.zeros(len(number), np.uint8)
    for s, i in number.items():
        final[i] = accept[s]
    columns = [np.array(x, np.int64) for x in zip(*rows)] or [np.zeros(0, np.int64)] * 3
    return {"key": columns[0], "target": columns[1], "skip": columns[2], "final": final.astype(np.int64)}


class Lexicon:
    """The automaton's arrays over a memory-mapped file."""

    NAMES = ("key", "target", "skip", "final", "starts", "ids")

    def __init__(self, path: str) -> None:
        head = np.memmap(path, np.int32, "r", shape=(len(self.NAMES) + 1,))
        at = head.nbytes
        self.longest = int(head[-1])
        for name, n in zip(self.NAMES, head[:-1].tolist()):
            value = np.memmap(path, np.int32, "r", at, (n,)) if n else np.zeros(0, np.int32)
            setattr(self, name, value)
            at += 4 * n

    @classmethod
    def write(cls, words: list[bytes], ids: list[bytes], path: str) -> None:
        """``words`` sorted and distinct, with the ids of each."""
        arrays = build_automaton(words)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        arrays["starts"] = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int64)
        arrays["ids"] = flat
        with open(path, "wb") as f:
            f.write(np.array([*(len(arrays[n]) for n in cls.NAMES), max(map(len, words), default=0)],
                             np.int32).tobytes())
            for n in cls.NAMES:
                f.write(arrays[n].astype(np.int32).tobytes())

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word, None for words that are not in the lexicon; all
        words walk the automaton together, one byte at a time."""
        out: list[bytes | None] = [None] * len(words)
        known = [i for i, w in enumerate(words) if len(w) <= self.longest]
        if not known or not len(self.key):
            return out
        size = np.array([len(words[i]) for i in known])
        width = int(size.max())
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in known),
                            np.uint8).reshape(len(known), width)
        state, number = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for j in range(width):
            go = np.flatnonzero((size > j) & (state >= 0))
            if not len(go):
                break
            key = (state[go] * 256 + raw[go, j]).astype(np.int32)
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            number[go] += np.where(ok, self.skip[at], 0)
            state[go] = np.where(ok, self.target[at], -1)
        hit = np.flatnonzero((state >= 0) & (self.final[np.maximum(state, 0)] == 1))
        starts = self.starts
        for k in hit.tolist():
            n = number[k]
            out[known[k]] = self.ids[starts[n]:starts[n + 1]].astype("<u4").tobytes()
        return out


class Encoder:
    """Encodes texts; keeps the ids of the words it has met in arrays sorted by
    the word's hash (a second 64-bit hash tells words apart that share it)."""

    def __init__(self, path: str, lexicon: str | None = None) -> None:
        self.vocabulary = Vocabulary(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self._forget()

    def _forget(self) -> None:
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.store, self.used = np.empty(1 << 20, np.uint32), 0

    def encode_words(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of runs of text without ASCII white space: lexicon, else merge."""
        v = self.vocabulary
        cut = [p for a in range(0, len(chunks), 1024) for p in v.pieces(chunks[a:a + 1024])]
        ids: dict[bytes | int, bytes] = {i: struct.pack("<I", i) for i in v.special.values()}
        words = list({p for p in chain.from_iterable(cut) if isinstance(p, bytes)})
        if self.lexicon is not None:
            ids.update((w, x) for w, x in zip(words, self.lexicon.find(words)) if x is not None)
            words = [w for w in words if w not in ids]
        ids.update(zip(words, v.merge(words)))
        get = ids.__getitem__
        return [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in cut]

    def _learn(self, words: Words, rows: np.ndarray) -> None:
        """Add the words at ``rows`` (one of each) to the known ones."""
        raw = words.data.tobytes()
        ids = self.encode_words([raw[a:b] for a, b in zip(words.first[rows].tolist(), words.last[rows].tolist())])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.empty_like(self.store)])
        self.store[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        order = np.argsort(words.ids[rows])
        rows, at, size = rows[order], at[order], size[order]
        spot = np.searchsorted(self.key, words.ids[rows])
        self.key = np.insert(self.key, spot, words.ids[rows])
        self.check = np.insert(self.check, spot, words.second[rows])
        self.at = np.insert(self.at, spot, at)
        self.size = np.insert(self.size, spot, size.astype(np.int32))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of ``column`` in one array (null text: none), and
        where each text begins in it, with the total at the end."""
        words = Words(column, second=True)
        n = len(words.ids)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(words.starts), np.int64)
        if len(self.key) > CACHE_WORDS:
            self._forget()
        coded = pa.array(words.ids).dictionary_encode()
        code, key = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        row = np.empty(len(key), np.int64)
        row[code[::-1]] = np.arange(n - 1, -1, -1)
        if (words.second != words.second[row][code]).any():
            return self._plain(words)
        spot = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        if len(self.key):
            known = self.key[np.minimum(spot, len(self.key) - 1)] == key
        if not known.all():
            self._learn(words, row[~known])
            spot = np.searchsorted(self.key, key)
        if (self.check[spot] != words.second[row]).any():
            return self._plain(words)
        at, size = self.at[spot][code], self.size[spot][code].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.store[np.arange(ends[-1]) + np.repeat(at - (ends - size), size)]
        return ids, np.concatenate([[0], ends])[words.starts]

    def _plain(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes, for texts in which two words share one."""
        raw = words.data.tobytes()
        cut = [raw[a:b] for a, b in zip(words.first.tolist(), words.last.tolist())]
        ids = self.encode_words(cut)
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        return np.frombuffer(b"".join(ids), "<u4"), ends[words.starts]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, lexicon: str | None = None) -> Encoder:
    """The worker's encoder (workers outlive tasks, so its cache does too)."""
    if (path, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, lexicon] = Encoder(path, lexicon)
    return _ENCODERS[path, lexicon]


def word_counts(docs: DataFrame, column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """How often each word occurs in all texts: (word binary, n long).  Each
    task sends one row per distinct word of some megabytes of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(vocabulary_path(vocabulary)).vocabulary
        raw: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words: Counter = Counter()
            chunks = list(raw)
            for a in range(0, len(chunks), 1024):
                for chunk, cut in zip(chunks[a:a + 1024], v.pieces(chunks[a:a + 1024])):
                    for p in cut:
                        if isinstance(p, bytes):
                            words[p] += raw[chunk]
            raw.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for part in slices(batches, column, 4 * SLICE_BYTES):
            cut = pc.ascii_split_whitespace(pc.fill_null(part.column(column).cast(pa.string()), "")).flatten()
            n = pc.value_counts(cut.filter(pc.greater(pc.binary_length(cut), 0)))
            raw.update(dict(zip(as_bytes(n.field("values")), n.field("counts").to_pylist())))
            if len(raw) > COUNTED_WORDS:
                yield rows()
        if raw:
            yield rows()

    sent = docs.select(column).mapInArrow(count, "word binary, n long")
    return sent.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, column: str = "text", size: int = LEXICON_WORDS,
                  vocabulary: str = VOCABULARY) -> str:
    """Compile up to ``size`` of the most frequent words (of up to
    ``ARRAY_BYTES`` bytes, met twice or more) of all texts; ship the file to
    the executors and return its name there."""
    # a step holds the words of about one frequency; whole steps are taken while
    # they fit, so the driver gets the steps' sizes and no more than ``size`` words
    counts = checkpointed(word_counts(docs, column, vocabulary).where(
        (F.octet_length("word") <= ARRAY_BYTES) & (F.col("n") > 1)).withColumn("step", F.floor(F.log2("n") * 16)))
    sizes = {r["step"]: r["m"] for r in counts.groupBy("step").agg(F.count(F.lit(1)).alias("m")).collect()}
    least, held = None, 0
    for step in sorted(sizes, reverse=True):
        held += sizes[step]
        if held > size:
            break
        least = step
    top = counts.where(F.col("step") >= least).select("word").collect() if least is not None else []
    words = sorted(bytes(r.word) for r in top)
    ids = Vocabulary(vocabulary_path(vocabulary)).merge(words)
    name = f"lexicon-{hashlib.sha256(b' '.join(words)).hexdigest()[:16]}.bin"
    # equal lexicons have one name and place, so a later build ships nothing anew
    folder = os.path.join(tempfile.gettempdir(), f"tablemine-lexicons-{os.getpid()}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    Lexicon.write(words, ids, path)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, column: str = "text", lexicon: str | None = None,
           vocabulary: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """Add the token ids of ``column`` as an array of int (null text: empty)."""
    schema = extended(docs.drop(out), **{out: "array<int>"})
    keep = [f.name for f in docs.drop(out).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path(vocabulary), lexicon and SparkFiles.get(lexicon))
        for part in slices(batches, column):
            ids, starts = enc.encode(part.column(column))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists], [*keep, out])

    return docs.drop(out).mapInArrow(run, schema)


def decode(df: DataFrame, column: str = "ids", vocabulary: str = VOCABULARY, out: str = "decoded") -> DataFrame:
    """Add the decoded text of an array of ids (null: null).  The vocabulary
    file names no decoder, so its tokens stand one space apart."""
    schema = extended(df.drop(out), **{out: "string"})
    keep = [f.name for f in df.drop(out).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(vocabulary_path(vocabulary)).vocabulary
        for part in batches:
            texts = [None if x is None else " ".join(map(v.tokens.__getitem__, x))
                     for x in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string())],
                                             [*keep, out])

    return df.drop(out).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, lexicon: str | None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, number of tokens, digest of the ids, digest of the decoded text,
    in one pass, so that ids and texts stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path(vocabulary), lexicon and SparkFiles.get(lexicon))
        numbers = [str(i).encode() for i in range(len(enc.vocabulary.tokens))]
        tokens = [t.encode() for t in enc.vocabulary.tokens]
        sha = hashlib.sha256
        for part in slices(batches, "text"):
            count, a, b = [], [], []
            ids, starts = enc.encode(part.column("text"))
            for k, m in zip(starts[:-1].tolist(), starts[1:].tolist()):
                values = ids[k:m].tolist()
                count.append(len(values))
                a.append(sha(b" ".join(map(numbers.__getitem__, values))).hexdigest())
                b.append(sha(b" ".join(map(tokens.__getitem__, values))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(a), pa.array(b)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every text of ``documents``.

    Null and empty texts have no tokens; repeated rows each give a row; an
    empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    return round_trip_digests(docs, build_lexicon(docs))
