"""Queries for keyword / algorithm filters and corpus counts.

Documents come either from the driver's ``documents`` table as they are,
or rendered from ``orders`` with one SQL expression that both Spark and
the DuckDB oracle evaluate (so both sides see byte-identical text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ALGORITHMS, KEYWORDS
from ..operators.keywords import (algorithm_filter, algorithm_regex, keyword_context,
                                  keyword_filter, keyword_table_filter)
from ..operators.summary import count_by_algorithm, corpus_summary
from .queries import read, register


# ------------------------------------------------------------ RE2 oracles
def _re2(term: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in term)


def _re2_pattern(alternatives: list[str], plural: bool) -> str:
    body = "(?:" + "|".join(_re2(a) for a in alternatives) + ")" + ("s?" if plural else "")
    return r"(?i)(^|[^\pL\pN_-])" + body + r"($|[^\pL\pN_-])"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits_sql(text: str, terms: list[tuple[str, list[str]]], plural: bool) -> str:
    items = ", ".join(
        f"CASE WHEN regexp_matches({text}, {_sql_str(_re2_pattern(alts, plural))}) "
        f"THEN {_sql_str(name)} END" for name, alts in terms)
    return f"list_sort(list_filter([{items}], lambda x: x IS NOT NULL))"


KEYWORD_TERMS = [(kw, [kw]) for kw in KEYWORDS]
ALGORITHM_TERMS = [(a, [a, f]) for a, f in ALGORITHMS]

# ------------------------------------------------- papers rendered from orders
# Each order becomes a short "paper".  pmod(orderkey, 13) picks the mention:
# 0-9 one of the ten algorithms, written (by custkey mod 4) as the bare
# abbreviation, the lower-cased full name, "(ABBR)", or only glued to
# other words (no match); 10 "SLiC" alone, 11 a plural "DPOs", 12 a
# citation "\cite{DPO}".
_ALGO_CASES = "\n".join(
    f"      WHEN {i} THEN CASE o_custkey % 4 "
    f"WHEN 0 THEN {_sql_str('We train with ' + a + ' on the data.')} "
    f"WHEN 1 THEN {_sql_str('we follow ' + f.lower() + ' here.')} "
    f"WHEN 2 THEN {_sql_str('The method (' + a + ') is used.')} "
    f"ELSE {_sql_str('Baselines x-' + a + ' and ' + a + '-LoRA only.')} END"
    for i, (a, f) in enumerate(ALGORITHMS))
PAPER_TEXT_SQL = f"""concat('Order ', CAST(o_orderkey AS STRING), ' of customer ',
    CAST(o_custkey AS STRING), ' has priority ', o_orderpriority, ' and status ',
    o_orderstatus, '.' || chr(10),
    CASE o_orderkey % 13
{_ALGO_CASES}
      WHEN 10 THEN 'We compare to SLiC and to reward modeling.'
      WHEN 11 THEN 'Several DPOs were trained with RLHF.'
      ELSE 'As in ' || chr(92) || 'cite{{DPO}}, preference optimization helps.'
    END)"""


def order_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("paper_id"), F.expr(PAPER_TEXT_SQL).alias("text"))


_ORDER_PAPERS_SQL = f"(SELECT o_orderkey AS paper_id, {PAPER_TEXT_SQL} AS text FROM orders)"


_KEYWORD_NAMES = [alts[0] for _, alts in KEYWORD_TERMS]
# every third document gets a sentence with one of the keywords, every sixth its plural
_MARKED_SQL = """concat(text, CASE WHEN doc_id % 3 = 0 THEN concat('. On ', {pick},
  CASE WHEN doc_id % 6 = 0 THEN 's' ELSE '' END, ' here.') ELSE '' END)"""
_MARKED_DUCK = _MARKED_SQL.format(pick="[" + ", ".join(map(_sql_str, _KEYWORD_NAMES))
                                  + f"][CAST(doc_id // 3 % {len(_KEYWORD_NAMES)} + 1 AS BIGINT)]")
_MARKED_SPARK = _MARKED_SQL.format(pick="element_at(split('" + "|".join(_KEYWORD_NAMES)
                                   + f"', '[|]'), cast(doc_id div 3 % {len(_KEYWORD_NAMES)} + 1 as int))")


@register("keyword_filter", f"""
SELECT doc_id, array_to_string(kws, '|') AS keywords FROM (
  SELECT doc_id, {_hits_sql('text', KEYWORD_TERMS, True)} AS kws
  FROM (SELECT doc_id, {_MARKED_DUCK} AS text FROM documents))
WHERE len(kws) > 0
""")
def q_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 83 fixed keywords over the whole ``documents`` table, with each
    keyword in some documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(_MARKED_SPARK).alias("text"))
    return keyword_filter(docs).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


@register("keyword_filter_papers", f"""
SELECT paper_id, array_to_string(kws, '|') AS keywords FROM (
  SELECT paper_id, {_hits_sql('text', KEYWORD_TERMS, True)} AS kws FROM {_ORDER_PAPERS_SQL})
WHERE len(kws) > 0
""")
def q_keyword_filter_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (keyword_filter(order_papers(spark, sf_dir))
            .select("paper_id", F.array_join("keywords", "|").alias("keywords")))


_ALGOS_SQL = f"""(SELECT paper_id, {_hits_sql('text', ALGORITHM_TERMS, False)} AS algos
                 FROM {_ORDER_PAPERS_SQL})"""


@register("algorithm_filter", f"""
SELECT paper_id, array_to_string(algos, '|') AS algorithms FROM {_ALGOS_SQL} WHERE len(algos) > 0
""")
def q_algorithm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (algorithm_filter(order_papers(spark, sf_dir))
            .select("paper_id", F.array_join("algorithms", "|").alias("algorithms")))


@register("count_by_algorithm", f"""
SELECT algorithm, count(*) AS n_papers FROM (
  SELECT unnest(algos) AS algorithm FROM {_ALGOS_SQL}) GROUP BY algorithm
UNION ALL
SELECT 'Total' AS algorithm, count(*) AS n_papers FROM {_ALGOS_SQL} WHERE len(algos) > 0
""")
def q_count_by_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_algorithm(algorithm_filter(order_papers(spark, sf_dir)))


def _context_sql() -> str:
    # first hit of each algorithm: full match m (with its guard chars), then
    # the 0-based start of the term inside the text
    parts = []
    for a, f in ALGORITHMS:
        pat = _sql_str(r"(?i)(^|[^\pL\pN_-])(" + _re2(a) + "|" + _re2(f) + r")($|[^\pL\pN_-])")
        parts.append(f"""SELECT paper_id, {_sql_str(a)} AS algorithm,
            strpos(text, regexp_extract(text, {pat}, 0)) - 1
              + length(regexp_extract(text, {pat}, 1)) AS s,
            length(regexp_extract(text, {pat}, 2)) AS n, text
          FROM {_ORDER_PAPERS_SQL} WHERE regexp_matches(text, {pat})""")
    union = "\nUNION ALL\n".join(parts)
    return f"""SELECT paper_id, algorithm,
        replace(substring(text, greatest(s - 30, 0) + 1,
                          least(length(text), s + n + 30) - greatest(s - 30, 0)), chr(10), ' ')
          AS context
      FROM ({union})"""


@register("keyword_context", _context_sql())
def q_keyword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 characters around the first hit of each detected algorithm."""
    papers = order_papers(spark, sf_dir)
    terms = F.array(*[F.struct(F.lit(a).alias("algorithm"),
                               F.lit(algorithm_regex(a, f)).alias("rx")) for a, f in ALGORITHMS])
    hits = algorithm_filter(papers).select("paper_id", "text", F.explode("algorithms").alias("algorithm"))
    rx = F.filter(terms, lambda t: t["algorithm"] == F.col("algorithm"))[0]["rx"]
    return hits.select("paper_id", "algorithm", keyword_context(F.col("text"), rx).alias("context"))


@register("corpus_summary", f"""
SELECT count(*) AS papers_in, CAST(count_if(len(algos) > 0) AS BIGINT) AS papers_kept,
       CAST(coalesce(sum(len(algos)), 0) AS BIGINT) AS algorithm_hits
FROM {_ALGOS_SQL}
""")
def q_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.keywords import algorithm_terms, matched_terms
    papers = order_papers(spark, sf_dir).withColumn("algos", matched_terms("text", algorithm_terms()))
    return corpus_summary(papers, "algos")


# ------------------------------------------- keyword table derived from data
_BENCH_WORDS_SQL = r"""(SELECT DISTINCT w AS keyword FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[\pL\pN_-]+')) AS w FROM benchmark)
  WHERE length(w) >= 9)"""


def benchmark_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword table derived from the data: distinct words of at least nine
    characters in the ``benchmark`` items (whose passages recur in
    ``documents``)."""
    b = read(spark, sf_dir, "benchmark")
    return (b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_-]+"), 0))
                     .alias("keyword"))
            .filter(F.length("keyword") >= 9).distinct())


@register("keyword_table_filter", rf"""
WITH runs AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_-]+')) AS run
  FROM documents),
hits AS (
  SELECT DISTINCT r.doc_id, k.keyword FROM runs r JOIN {_BENCH_WORDS_SQL} k
    ON r.run = k.keyword OR r.run = k.keyword || 's')
SELECT doc_id, count(*) AS n_keywords, min(keyword) AS first_keyword, max(keyword) AS last_keyword
FROM hits GROUP BY doc_id
""")
def q_keyword_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = keyword_table_filter(docs, benchmark_keywords(spark, sf_dir))
    return (hits.groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n_keywords"), F.min("keyword").alias("first_keyword"),
                 F.max("keyword").alias("last_keyword")))


# all words of the benchmark, and the first two words of each item
_ALL_KEYWORDS_SQL = r"""(SELECT DISTINCT keyword FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[\pL\pN_-]+')) AS keyword FROM benchmark
    UNION ALL
    SELECT regexp_extract(lower(text), '^[^\pL\pN_-]*([\pL\pN_-]+ [\pL\pN_-]+)', 1) FROM benchmark)
  WHERE keyword <> '')"""


def all_benchmark_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword table derived from the data: distinct words of any length in
    the ``benchmark`` items, and each item's first two words where one space
    parts them."""
    b = read(spark, sf_dir, "benchmark").select(F.lower("text").alias("text"))
    words = b.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_-]+"), 0)).alias("keyword"))
    pairs = b.select(F.regexp_extract("text", r"^[^\p{L}\p{N}_-]*([\p{L}\p{N}_-]+ [\p{L}\p{N}_-]+)", 1)
                     .alias("keyword"))
    return words.unionByName(pairs).filter("keyword <> ''").distinct()


@register("keyword_table_filter_all", rf"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN_-]+|[^\pL\pN_-]+') AS parts FROM documents),
runs AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_-]+')) AS run FROM documents
  UNION
  SELECT doc_id, unnest(list_transform(list_filter(range(1, len(parts) - 1), lambda i: parts[i + 1] = ' '),
                                       lambda i: parts[i] || ' ' || parts[i + 2])) FROM t),
hits AS (
  SELECT r.doc_id, k.keyword FROM runs r JOIN {_ALL_KEYWORDS_SQL} k ON r.run = k.keyword
  UNION
  SELECT r.doc_id, k.keyword FROM runs r JOIN {_ALL_KEYWORDS_SQL} k ON r.run = k.keyword || 's')
SELECT doc_id, count(*) AS n_keywords, min(keyword) AS first_keyword, max(keyword) AS last_keyword
FROM hits GROUP BY doc_id
""")
def q_keyword_table_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``keyword_table_filter`` with words of any length and word pairs."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = keyword_table_filter(docs, all_benchmark_keywords(spark, sf_dir))
    return (hits.groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n_keywords"), F.min("keyword").alias("first_keyword"),
                 F.max("keyword").alias("last_keyword")))
