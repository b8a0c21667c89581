"""Quality rules by distribution divergence.

A document's histogram of character classes, and its histogram of common
words, is compared with a reference of each language by Jensen-Shannon
distance.  The references come from all documents of the language: first the
median share of each character class over documents that pass the base rules
(medians stand a large minority of junk), then the mean shares over those that
lie near it.  A document is held against the language it fits best, and a
distance counts only from a length on at which chance cannot explain it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpointed, extended, mix, read, slices
from .recompress import covered, whole_windows, windows_of

#: Common words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that it was for with as on are by this be from or at an have not",
    "de": "der die und das in den von zu mit ist im für auf ein eine nicht des dem sich als auch es an werden",
    "fr": "de la le et les des en un une que est pour qui dans par sur au pas du plus ne se ce avec",
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o",
}
LANGUAGES = tuple(COMMON_WORDS)
WORDS = tuple(sorted({w for x in COMMON_WORDS.values() for w in x.split()}))

#: Character classes: lower-case letters, capitals, digits, listed symbols,
#: sentence marks, other marks, letters beyond ASCII, control characters.
CLASSES = ("lower", "upper", "digit", "symbol", "sentence", "mark", "letter", "control")
SYMBOLS, SENTENCE = b"#*$%&|<>", b".,;:!?'\"()-"

#: Base rules, and the length from which a document helps to make a reference.
MIN_WORDS, MAX_REPEAT_PERCENT, REFERENCE_WORDS = 20, 30, 100
#: A distance of ``LIMIT + SLACK / sqrt(n)`` is allowed; nothing is judged
#: below ``LEAST`` characters or words.
CLASS_LIMIT, CLASS_SLACK, CLASS_LEAST = 0.15, 1.2, 200
WORD_LIMIT, WORD_SLACK, WORD_LEAST = 0.28, 1.5, 60

_CODE = np.full(256, len(CLASSES), np.int64)  # the last code: not counted
_CODE[0:32] = CLASSES.index("control")
_CODE[127] = CLASSES.index("control")
_CODE[33:127] = CLASSES.index("mark")
_CODE[[9, 10, 11, 12, 13, 32]] = len(CLASSES)
_CODE[list(SENTENCE)] = CLASSES.index("sentence")
_CODE[list(SYMBOLS)] = CLASSES.index("symbol")
_CODE[48:58] = CLASSES.index("digit")
_CODE[65:91] = CLASSES.index("upper")
_CODE[97:123] = CLASSES.index("lower")
_CODE[192:256] = CLASSES.index("letter")  # first byte of a character beyond ASCII


def repeat_words(ids: np.ndarray, starts: np.ndarray, width: int = 8) -> np.ndarray:
    """Per document, its words under a window of ``width`` words that the
    document holds twice or more."""
    n = len(ids)
    if n < width:
        return np.zeros(len(starts) - 1, np.int64)
    at = np.flatnonzero(whole_windows(starts, width))
    doc = np.searchsorted(starts, at, "right") - 1
    key = windows_of(ids, width, 0x9E3779B97F4A7C15)[at] ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = at[order[same]], at[order[same + 1]]
    true = np.ones(len(a), bool)
    for j in range(width):
        true &= ids[a + j] == ids[b + j]
    under = covered(np.unique(np.concatenate([a[true], b[true]])), n, width)
    return np.diff(np.concatenate([[0], np.cumsum(under)])[starts])


class Measures:
    """Base counts and the two histograms of some texts."""

    def __init__(self, column: pa.Array) -> None:
        words = Words(column)
        n, k = len(column), len(CLASSES) + 1
        code = np.repeat(np.arange(n) * k, np.diff(words.bounds)) + _CODE[words.data]
        self.classes = np.bincount(code, minlength=n * k).reshape(n, k)[:, :-1]
        self.n_words = np.diff(words.starts)
        doc = np.repeat(np.arange(n), self.n_words)
        spot = np.minimum(np.searchsorted(_NAMES, words.ids), len(WORDS) - 1)
        hit = _NAMES[spot] == words.ids
        self.common = np.bincount(doc[hit] * len(WORDS) + _RANK[spot[hit]],
                                  minlength=n * len(WORDS)).reshape(n, len(WORDS))
        self.chars = self.classes.sum(1)
        self.symbols = self.classes[:, CLASSES.index("symbol")]
        self.repeat_words = repeat_words(words.ids, words.starts)
        self.dup_lines = np.zeros(n, np.int64)
        raw = words.data.tobytes()
        for k, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
            lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
            self.dup_lines[k] = len(lines) - len(set(lines))
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.repeat_words > MAX_REPEAT_PERCENT * self.n_words)


_NAMES = Words(pa.array([w.encode() for w in WORDS], pa.binary())).ids
_RANK = np.argsort(_NAMES)
_NAMES = _NAMES[_RANK]


def features(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Base counts and the two histograms of each text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda x: pa.ListArray.from_arrays(
            pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).astype(np.int64)))
        for part in slices(batches, "text"):
            m = Measures(part.column("text"))
            counts = (m.n_words, m.chars, m.symbols, m.dup_lines, m.repeat_words)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), *(pa.array(x.astype(np.int64)) for x in counts),
                 pa.array(m.base_failed), lists(m.classes), lists(m.common)],
                ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "classes", "common"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"),
                       lang.cast("string").alias("lang")).mapInArrow(
        run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, base_failed boolean, classes array<long>, common array<long>")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of rows ``p`` and one ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def references(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Character-class and common-word shares by language.  The driver gets a
    row of shares for each language of ``COMMON_WORDS``."""
    base = counted.where(~F.col("base_failed") & (F.col("n_words") >= REFERENCE_WORDS)
                         & F.col("lang").isin(*LANGUAGES))
    share = [(F.col("classes")[i] / F.col("word_chars")) for i in range(len(CLASSES))]
    median = {r["lang"]: np.array(r[1:], float) for r in base.groupBy("lang").agg(
        *[F.percentile_approx(s, 0.5, 1000).alias(f"c{i}") for i, s in enumerate(share)]).collect()}
    if not median:
        return {}
    off = F.lit(None).cast("double")
    for lang, m in median.items():
        gap = sum((F.abs(s - F.lit(float(x))) for s, x in zip(share, m)), F.lit(0.0))
        off = F.when(F.col("lang") == lang, gap).otherwise(off)
    typical = base.where(off <= CLASS_LIMIT)
    means = typical.groupBy("lang").agg(
        *[F.avg(s).alias(f"c{i}") for i, s in enumerate(share)],
        *[F.avg(F.col("common")[i] / F.col("n_words")).alias(f"w{i}") for i in range(len(WORDS))]).collect()
    out = {}
    for r in means:
        values = np.array(r[1:], float)
        classes, common = values[:len(CLASSES)], values[len(CLASSES):]
        out[r["lang"]] = (classes / classes.sum(), np.append(common, max(0.0, 1 - common.sum())))
    return out


def divergences(classes: np.ndarray, common: np.ndarray, chars: np.ndarray, n_words: np.ndarray,
                refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of both histograms to the best reference, and whether one of
    them is beyond what its length allows."""
    n = len(n_words)
    p = classes / np.maximum(chars, 1)[:, None]
    q = np.column_stack([common, n_words - common.sum(1)]) / np.maximum(n_words, 1)[:, None]
    a, b, fit = np.zeros(n), np.zeros(n), np.full(n, np.inf)
    for lang in sorted(refs):
        x, y = distance(p, refs[lang][0]), distance(q, refs[lang][1])
        better = x + y < fit
        fit = np.where(better, x + y, fit)
        a, b = np.where(better, x, a), np.where(better, y, b)
    bad = (chars >= CLASS_LEAST) & (a > CLASS_LIMIT + CLASS_SLACK / np.sqrt(np.maximum(chars, 1)))
    bad |= (n_words >= WORD_LEAST) & (b > WORD_LIMIT + WORD_SLACK / np.sqrt(np.maximum(n_words, 1)))
    return a, b, bad


def judge(counted: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add the distances to the best reference and ``kept``."""
    keep = [f.name for f in counted.schema.fields if f.name not in ("classes", "common", "lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            table = [part.column(c).flatten().to_numpy().reshape(part.num_rows, -1) for c in ("classes", "common")]
            a, b, bad = divergences(*table, part.column("word_chars").to_numpy(), part.column("n_words").to_numpy(), refs)
            kept = ~bad & ~part.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(a), pa.array(b), pa.array(kept)],
                                             [*keep, "class_distance", "word_distance", "kept"])

    schema = extended(counted.select(*keep), class_distance="double", word_distance="double", kept="boolean")
    return counted.mapInArrow(run, schema)


def keep_good(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows that ``quality_rules`` keeps, with all their columns: one pass
    for the references, one that judges and filters where the rows are."""
    refs = references(checkpointed(features(docs, id_column, column)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            m = Measures(part.column(column))
            _, _, bad = divergences(m.classes, m.common, m.chars, m.n_words, refs)
            yield part.filter(pa.array(~bad & ~m.base_failed))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per input row: base counts, distances, and whether it is kept.

    Null text has no words and fails the base rules, like an empty one.  A
    document of an unknown language is held against all references; without
    any reference (no long document in a known language) the base rules alone
    decide.  Repeated rows each give a row; an empty table gives none; other
    columns are ignored.
    """
    counted = checkpointed(features(docs, id_column, column))
    return judge(counted, references(counted))


def op1_divergence(spark, sf_dir: str) -> DataFrame:
    """Quality verdicts on all ``documents``."""
    return quality_rules(read(spark, sf_dir, "documents"))
