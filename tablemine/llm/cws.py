"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts as weights.  For each of ``SAMPLES``
numbers k and each word, hashes of (word, k) give r and c, drawn from a gamma
distribution with shape 2, and a uniform b.  With t = floor(ln(weight) / r + b)
the word bids c / exp(r (t - b)) / exp(r); the sample is the (word, t) of the
lowest bid.  Two documents have the same sample k with a probability equal to
their generalised Jaccard similarity, so the share of equal samples estimates
it.  All of it is built-in column functions: a bid and its sample's 31 bits
share one long, so the lowest bid is a plain minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, parts_for, read

SAMPLES = 32
#: Documents of a range of ids, and ranges that one percentile call makes.
RANGE_DOCS, COARSE = 500, 1_024


def _uniform(bits: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part + F.lit(0.5)) / F.lit(float(1 << width))


def bid(word: Column, log_weight: Column, k: int) -> Column:
    """The bid of a word for sample k, as one long: 32 bits of the bid's
    logarithm above 31 bits that name (word, t)."""
    a, b = F.xxhash64(word, F.lit(2 * k)), F.xxhash64(word, F.lit(2 * k + 1))
    r = -F.log(_uniform(a, 40, 24) * _uniform(a, 16, 24))
    beta = _uniform(b, 40, 24)
    c = -F.log(_uniform(b, 20, 20) * _uniform(b, 0, 20))
    t = F.floor(log_weight / r + beta)
    value = F.log(c) - r * (t - beta) - r
    high = F.floor((F.greatest(value, F.lit(-63.0)) + 64) * F.lit(float(1 << 25)))
    name = F.xxhash64(word, t, F.lit(k)).bitwiseAND(F.lit((1 << 31) - 1))
    return F.shiftleft(high, 31).bitwiseOR(name)


def fingerprints(texts: DataFrame, key: list[str], column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key..., fingerprint): 8 hex digits for each sample.  Texts without a
    word are missing.  If the rows are already dealt by the first key column,
    nothing is shuffled."""
    words = texts.select(*key, F.explode(F.split(column, "[\\x20\\x09-\\x0D]+")).alias("_w")).where("_w <> ''")
    terms = words.groupBy(*key, F.xxhash64("_w").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    terms = terms.withColumn("_l", F.log(F.col("_n").cast("double")))
    best = terms.groupBy(*key).agg(*[F.min(bid(F.col("_t"), F.col("_l"), k)).alias(f"_s{k}") for k in range(samples)])
    names = [F.lpad(F.lower(F.hex(F.col(f"_s{k}").bitwiseAND(F.lit((1 << 31) - 1)))), 8, "0") for k in range(samples)]
    return best.select(*key, F.concat(*names).alias("fingerprint"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def with_next(docs: DataFrame, id_column: str, column: str) -> DataFrame:
    """Rows with the text of the next row by id (after the last: the first),
    without one task for all: ids are cut into ranges, the rows of a range meet
    in a window, and its last row gets the first text of the next range.

    Adds ``range``, ``row`` (number in it) and ``next`` (columns of these names
    are replaced); a null text becomes empty.  Null ids come first; rows with
    equal ids follow each other.
    """
    docs = docs.drop("range", "row", "next").withColumn(column, F.coalesce(column, F.lit("")))
    place = F.coalesce(id_column, F.lit(-(1 << 63)))
    n = docs.count()
    coarse = min(COARSE, parts_for(n, RANGE_DOCS))
    fine = parts_for(n, RANGE_DOCS * coarse)
    # COARSE + 1 ids at most; equal widths between two of them
    bounds = sorted(set(docs.select(place.alias("p")).agg(F.percentile_approx(
        "p", [k / coarse for k in range(coarse + 1)], 20 * coarse).alias("b")).first()["b"] or [0]))
    edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    part = F.size(F.filter(edges, lambda e: e <= place))
    low = F.get(edges, F.greatest(part - 1, F.lit(0))).cast("double")
    span = F.greatest(F.coalesce(F.get(edges, part).cast("double") - low, F.lit(1.0)), F.lit(1.0))
    inside = F.least(F.floor((place.cast("double") - low) / span * fine), F.lit(fine - 1))
    range_ = part.cast("long") * (1 << 32) + F.greatest(inside, F.lit(0)).cast("long")
    tie = F.xxhash64(column)
    dealt = docs.withColumn("range", range_)
    known = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("m")).withColumn("part", F.shiftright("range", 32))
    firsts = known.groupBy("part").agg(F.min("range").alias("first"))
    # at most COARSE + 1 rows
    later = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")),
                                             F.first("first").over(Window.orderBy("part"))).alias("later"))
    before = known.join(later, "part").select("range", F.coalesce(F.lead("range").over(
        Window.partitionBy("part").orderBy("range")), "later").alias("_after"))
    # the first text of each range also stands at the end of the range before it
    heads = dealt.groupBy("range").agg(F.min(F.struct(
        F.col(id_column).isNotNull().alias("a"), F.col(id_column).alias("b"), tie.alias("c"),
        F.col(column).alias("t"))).alias("h")).select(F.col("range").alias("_after"), "h.t")
    ends = before.join(heads, "_after").select("range", *[
        (F.col("t") if c == column else F.lit(None).cast(docs.schema[c].dataType)).alias(c) for c in docs.columns],
        F.lit(True).alias("_end"))
    rows = dealt.select("range", *docs.columns, F.lit(False).alias("_end")).union(ends)
    order = Window.partitionBy("range").orderBy("_end", F.asc_nulls_first(id_column), tie)
    return rows.withColumns({"row": F.row_number().over(order), "next": F.lead(column).over(order)}).where(
        "not _end").drop("_end")


def op10_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_next(docs, "doc_id", "text").withColumn("half", F.floor(F.char_length("text") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("half")),
                      F.substring("next", F.lit(1), F.col("half")))
    rows = rows.select("range", "row", "doc_id", "text", edited.alias("edited"))
    both = rows.select("range", "row", F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text")),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))))
    none = F.lit("0" * 8 * SAMPLES)
    own = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("fingerprint"))), none)
    facts = rows.select("range", "row", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
                        F.sha2("edited", 256).alias("edited_sha256"))
    found = fingerprints(both, ["range", "row", "kind"]).groupBy("range", "row").agg(
        own(0).alias("f"), own(1).alias("e"))
    done = checkpointed(facts.join(found, ["range", "row"], "left").select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("f", none).alias("fingerprint"),
        F.coalesce("e", none).alias("edited_fingerprint")))
    return with_next(done, "doc_id", "fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next").alias("near_next"))
