"""Queries for answers, records, metrics, post-processing and prompts.

Fixtures are rendered from driver tables.  Where both engines can build
the same text, the rendering is one SQL expression used by Spark
(``F.expr``) and by the DuckDB oracle alike; where only Spark renders
(ordered per-group JSON lines), the oracle is plain SQL on the source rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RECORD_FIELDS
from ..functions import answers as A
from ..functions.common import strip_ws
from ..operators import dedupe as D
from ..operators.metrics import (METRIC_RULES, alias_regex, parse_metric_answer, rule_table, standardize_metric,
                                standardize_metric_by_rules)
from ..operators.records import (drop_failed_answers, drop_failed_counted, extract_records, flatten_records,
                                parse_jsonl_records)
from ..operators.summary import failure_counts
from .queries import read, register
from .render import bounded_chunks

# ------------------------------------------------------------ RT-JSONL
# One answer per order: "<think>…</think>" then one JSON object per line
# item.  orderkey % 7 = 0 adds a malformed line, % 11 = 0 never closes the
# thought (→ <FAILED>), % 13 = 0 is the bare <FAILED> answer.
RECORD_SQL = {
    "value": "CAST(CAST(l_quantity AS DECIMAL(12,2)) AS STRING)",
    "metric": "CASE l_returnflag WHEN 'A' THEN 'Accuracy' WHEN 'R' THEN 'd-BLEU' ELSE 'F1-score' END",
    "evaluation_method": "'zero-shot'",
    "benchmark_or_task": "concat('task-', CAST(l_suppkey AS STRING))",
    "dataset": "concat('part-', CAST(l_partkey AS STRING))",
    "dataset_citation_tag": "concat('p', CAST(l_partkey AS STRING))",
    "subset": "concat('line-', CAST(l_linenumber AS STRING))",
    "base_model": "concat('model-', CAST(l_suppkey % 5 AS STRING))",
    "pref_tuning_method": "CASE WHEN l_linenumber = 1 THEN 'xx' ELSE 'DPO' END",
    "hyperparameters": "'xx'",
    "PEFT": "'xx'",
}
assert list(RECORD_SQL) == RECORD_FIELDS


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    rec = F.to_json(F.struct(*[F.expr(RECORD_SQL[f]).alias(f) for f in RECORD_FIELDS]))
    li = bounded_chunks(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                  rec.alias("line")),
                        "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])
    g = li.groupBy("l_orderkey", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line")))
        .alias("rows"))
    k = F.col("l_orderkey")
    lines = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    answer = (F.when(k % 13 == 0, F.lit("<FAILED>"))
               .otherwise(F.concat(
                   F.lit("<think>checking order "), k.cast("string"),
                   F.when(k % 11 == 0, F.lit("\n")).otherwise(F.lit(" done</think>\n")),
                   lines,
                   F.when(k % 7 == 0, F.lit('\n{"value": "1", "metric": ')).otherwise(F.lit("")))))
    return g.select("l_orderkey", "chunk", answer.alias("table_results_raw"))


_FAILED_ORDER = "(l_orderkey % 13 = 0 OR l_orderkey % 11 = 0)"


@register("strip_reasoning", f"""
SELECT DISTINCT l_orderkey, CASE WHEN {_FAILED_ORDER} THEN 1 ELSE 0 END AS failed FROM lineitem
""")
def q_strip_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = order_answers(spark, sf_dir).withColumn("ans", A.strip_reasoning("table_results_raw"))
    return a.groupBy("l_orderkey").agg(
        F.max(F.when(F.col("ans") == "<FAILED>", 1).otherwise(0)).alias("failed"))


@register("failure_counts", f"""
SELECT count(*) AS n_total, CAST(count_if({_FAILED_ORDER}) AS BIGINT) AS n_failed
FROM (SELECT DISTINCT l_orderkey FROM lineitem)
""")
def q_failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = order_answers(spark, sf_dir).withColumn("ans", A.strip_reasoning("table_results_raw"))
    return failure_counts(a, "ans")


@register("drop_failed_counted", f"""
SELECT count(*) AS n_total, CAST(count_if({_FAILED_ORDER}) AS BIGINT) AS n_failed,
       CAST(count_if(NOT {_FAILED_ORDER}) AS BIGINT) AS n_written
FROM (SELECT DISTINCT l_orderkey FROM lineitem)
""")
def q_drop_failed_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts observed by the job that writes the kept answers."""
    import uuid

    from ..session import ensure_checkpoint_dir
    a = order_answers(spark, sf_dir).withColumn("ans", A.strip_reasoning("table_results_raw"))
    kept, counted = drop_failed_counted(a.select("l_orderkey", "ans"), "ans")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept-answers-{uuid.uuid4().hex}"
    kept.write.parquet(path)
    seen = counted.get
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_written")).select(
        F.lit(seen["n_total"]).cast("long").alias("n_total"), F.lit(seen["n_failed"]).cast("long").alias("n_failed"), "n_written")


@register("drop_failed_answers", f"""
SELECT DISTINCT l_orderkey FROM lineitem WHERE NOT {_FAILED_ORDER}
""")
def q_drop_failed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = extract_records(order_answers(spark, sf_dir), "table_results_raw", "table_results_extracted")
    return a.select("l_orderkey").distinct()


@register("parse_jsonl_records", f"""
SELECT l_orderkey, count(*) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS n_lines,
       count(*) AS n_records
FROM lineitem WHERE NOT {_FAILED_ORDER} GROUP BY l_orderkey
""")
def q_parse_jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = extract_records(order_answers(spark, sf_dir), "table_results_raw", "ans")
    p = parse_jsonl_records(a, "ans").withColumn(
        "n_lines", F.size(F.split(strip_ws(F.col("ans")), A.LINE_BREAKS)))
    return p.groupBy("l_orderkey").agg(F.sum("n_lines").cast("bigint").alias("n_lines"),
                                       F.sum(F.size("records")).cast("bigint").alias("n_records"))


@register("flatten_records", "SELECT l_orderkey, " + ", ".join(
    f"{e} AS {f}" for f, e in RECORD_SQL.items()) + f" FROM lineitem WHERE NOT {_FAILED_ORDER}")
def q_flatten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = extract_records(order_answers(spark, sf_dir), "table_results_raw", "ans")
    flat = flatten_records(parse_jsonl_records(a, "ans"))
    return flat.select("l_orderkey", *[F.col("record")[f].alias(f) for f in RECORD_FIELDS])


# ------------------------------------------------------------ RT-METRIC
METRIC_INPUT_SQL = {
    "metric": ("CASE event_type WHEN 'view' THEN 'Sentiment Analysis Accuracy' "
               "WHEN 'signup' THEN 'd-BLEU' WHEN 'click' THEN 'F1-score' "
               "WHEN 'error' THEN 'Fleuncy' ELSE 'Win Rate (%)' END"),
    "value": ("CASE WHEN event_id % 3 = 0 THEN "
              "CAST(CAST(CAST(value AS DECIMAL(12,2)) / 100 AS DECIMAL(12,4)) AS STRING) "
              "ELSE concat(CAST(CAST(value AS DECIMAL(12,2)) AS STRING), "
              "CASE WHEN event_id % 5 = 0 THEN '%' ELSE '' END) END"),
}


def _metric_oracle() -> str:
    def case(field):
        parts = []
        for std, fam, aliases in METRIC_RULES:
            cond = " OR ".join(f"regexp_matches(metric, '{alias_regex(a)}')" for a in aliases)
            parts.append(f"WHEN {cond} THEN '{std if field == 0 else fam}'")
        return "CASE " + " ".join(parts) + " END"
    return f"""
SELECT event_id, std AS standardized_metric,
       CAST(CASE WHEN fam = 'percent' AND v < 1 THEN v * 100 ELSE v END AS DOUBLE)
         AS adjusted_metric_value
FROM (SELECT event_id, {case(0)} AS std, {case(1)} AS fam,
             TRY_CAST(regexp_extract(value, '[-+]?(\\d+\\.?\\d*|\\.\\d+)', 0) AS DECIMAL(38,12)) AS v
      FROM (SELECT event_id, {METRIC_INPUT_SQL['metric']} AS metric,
                   {METRIC_INPUT_SQL['value']} AS value FROM events))
WHERE std IS NOT NULL AND v IS NOT NULL
"""


@register("standardize_metric_rules", _metric_oracle())
def q_standardize_metric_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed rules as a rule table."""
    ev = read(spark, sf_dir, "events")
    recs = ev.select("event_id", *[F.expr(e).alias(k) for k, e in METRIC_INPUT_SQL.items()])
    return standardize_metric_by_rules(recs, rule_table(spark)).select(
        "event_id", "standardized_metric", "adjusted_metric_value")


@register("standardize_metric", _metric_oracle())
def q_standardize_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    recs = ev.select("event_id", *[F.expr(e).alias(k) for k, e in METRIC_INPUT_SQL.items()])
    return standardize_metric(recs).select("event_id", "standardized_metric", "adjusted_metric_value")


_ANSWER_NAME_SQL = ("CASE event_type WHEN 'view' THEN 'Accuracy' WHEN 'signup' THEN 'BLEU' "
                    "WHEN 'click' THEN 'F1' WHEN 'error' THEN 'MSE' ELSE 'Win Rate' END")
_ANSWER_VALUE_SQL = "CAST(CAST(value AS DECIMAL(12,2)) AS STRING)"
METRIC_ANSWER_SQL = f"""CASE event_id % 4
  WHEN 0 THEN concat('{{"Metric_Name": "', {_ANSWER_NAME_SQL}, '", "Metric_Value": ', {_ANSWER_VALUE_SQL}, '}}')
  WHEN 1 THEN concat('{{''Metric_Name'': ''', {_ANSWER_NAME_SQL}, ''', ''Metric_Value'': ', {_ANSWER_VALUE_SQL}, '}}')
  WHEN 2 THEN concat('```json', chr(10), '{{"Metric_Name": "', {_ANSWER_NAME_SQL}, '",', chr(10),
                     ' "Metric_Value": ', {_ANSWER_VALUE_SQL}, '}}', chr(10), '```')
  ELSE '<FAILED>' END"""


@register("parse_metric_answer", f"""
SELECT event_id, {_ANSWER_NAME_SQL} AS standardized_metric,
       CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS adjusted_metric_value
FROM events WHERE event_id % 4 <> 3
""")
def q_parse_metric_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_id", F.expr(METRIC_ANSWER_SQL).alias("answer"))
    return parse_metric_answer(ev).select("event_id", "standardized_metric", "adjusted_metric_value")


@register("invalid_record_stub", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_linenumber = 1 OR l_returnflag = 'N' THEN 'fluency' ELSE 'Accuracy' END AS metric,
  CASE WHEN l_linenumber = 1 OR l_returnflag = 'N' THEN '0'
       ELSE CAST(CAST(l_quantity AS DECIMAL(12,2)) AS STRING) END AS value
FROM lineitem
""")
def q_invalid_record_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import invalid_record_stub
    li = read(spark, sf_dir, "lineitem")
    m = F.when(F.col("l_returnflag") != "N", F.lit("Accuracy"))
    v = F.col("l_quantity").cast("decimal(12,2)").cast("string")
    meth = F.when(F.col("l_linenumber") == 1, F.lit("xx")).otherwise(F.lit("DPO"))
    metric, value = invalid_record_stub(m, v, meth)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     metric.alias("metric"), value.alias("value"))


# ------------------------------------------------- records for post-processing
FINAL_SQL = {
    "paper_id": "concat('o', CAST(l_orderkey AS STRING))",
    "dataset_name": ("CASE l_partkey % 17 WHEN 0 THEN 'xx' WHEN 1 THEN '' WHEN 2 THEN '<FAILED>' "
                     "WHEN 3 THEN NULL ELSE concat('part-', CAST(l_partkey % 40 AS STRING)) END"),
    "subset": "CASE WHEN l_suppkey % 3 = 0 THEN 'xx' ELSE concat('s', CAST(l_suppkey % 4 AS STRING)) END",
    "model_name": ("CASE l_suppkey % 11 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'xx' "
                   "ELSE concat('m', CAST(l_suppkey % 6 AS STRING)) END"),
    "metric": ("CASE WHEN l_linenumber = 5 THEN NULL WHEN l_returnflag = 'R' AND l_linenumber = 3 "
               "THEN 'xx' ELSE 'Accuracy' END"),
    "pref_tuning_method": "CASE WHEN l_orderkey % 19 = 0 THEN '<FAILED>' ELSE 'DPO' END",
    "hyperparameters": "CASE WHEN l_linenumber % 2 = 0 THEN 'xx' ELSE 'lr=1e-5' END",
    "metric_value": "CAST(CAST(l_quantity AS DECIMAL(12,2)) AS DOUBLE)",
    "dataset_description": (
        "CASE l_orderkey % 6 WHEN 0 THEN '<FAILED>' "
        "WHEN 1 THEN 'Dataset Summary: a. Task Explanation: b.' "
        "WHEN 2 THEN 'dataset summary only' "
        "WHEN 3 THEN 'Dataset Summary: a. Task Explanation: b. Subset Description: c.' "
        "WHEN 4 THEN 'TASK EXPLANATION and DATASET SUMMARY <FAILED>' "
        "ELSE 'task explanation; dataset summary' END"),
}
_FINAL_SELECT = ", ".join(f"{e} AS {k}" for k, e in FINAL_SQL.items())
_FINAL_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def final_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     *[F.expr(e).alias(k) for k, e in FINAL_SQL.items()])


@register("sentinel_filter", f"""
SELECT {_FINAL_KEYS} FROM (SELECT {_FINAL_KEYS}, {_FINAL_SELECT} FROM lineitem)
WHERE coalesce(dataset_name NOT IN ('', '<FAILED>', 'xx'), false)
  AND coalesce(metric NOT IN ('', '<FAILED>', 'xx'), false)
  AND coalesce(pref_tuning_method NOT IN ('', '<FAILED>', 'xx'), false)
  AND coalesce(model_name <> '', true)
""")
def q_sentinel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sentinel_filter(final_records(spark, sf_dir)).select(*_FINAL_KEYS.split(", "))


@register("description_filter", f"""
SELECT {_FINAL_KEYS} FROM (SELECT {_FINAL_KEYS}, {_FINAL_SELECT} FROM lineitem)
WHERE NOT contains(dataset_description, '<FAILED>')
  AND contains(lower(dataset_description), 'dataset summary')
  AND contains(lower(dataset_description), 'task explanation')
""")
def q_description_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.description_filter(final_records(spark, sf_dir)).select(*_FINAL_KEYS.split(", "))


@register("expect_subset_section", f"""
SELECT subset <> 'xx' AND NOT contains(dataset_description, 'Subset Description') AS was_violation,
       count(*) AS n_passed
FROM (SELECT {_FINAL_SELECT} FROM lineitem) GROUP BY 1
""")
def q_expect_subset_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack the section get it; then all must pass (a row without
    it would stop the query)."""
    rows = final_records(spark, sf_dir)
    bad = (F.col("subset") != "xx") & ~F.contains("dataset_description", F.lit("Subset Description"))
    rows = rows.withColumn("was_violation", bad).withColumn("dataset_description", F.when(
        F.col("was_violation"), F.concat("dataset_description", F.lit("\nSubset Description: given")))
        .otherwise(F.col("dataset_description")))
    return D.expect_subset_section(rows).groupBy("was_violation").agg(F.count(F.lit(1)).alias("n_passed"))


@register("dedupe_conflicting", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_partkey, l_suppkey) AS rn,
         min(v) OVER (PARTITION BY l_orderkey, l_linenumber) AS mn,
         max(v) OVER (PARTITION BY l_orderkey, l_linenumber) AS mx
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS v FROM lineitem))
WHERE rn = 1 AND mn = mx
""")
def q_dedupe_conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key (l_orderkey, l_linenumber), value l_linestatus as 0/1, input
    order (l_partkey, l_suppkey)."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("v"))
    return D.dedupe_conflicting(li, ["l_orderkey", "l_linenumber"], "v",
                                ["l_partkey", "l_suppkey"]).drop("v")


@register("dedupe_records", f"""
SELECT {_FINAL_KEYS} FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_name, subset, pref_tuning_method,
                                            hyperparameters, metric
                               ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn,
         min(metric_value) OVER (PARTITION BY dataset_name, subset, pref_tuning_method,
                                              hyperparameters, metric) AS mn,
         max(metric_value) OVER (PARTITION BY dataset_name, subset, pref_tuning_method,
                                              hyperparameters, metric) AS mx
  FROM (SELECT {_FINAL_KEYS}, {_FINAL_SELECT} FROM lineitem))
WHERE rn = 1 AND mn IS NOT DISTINCT FROM mx
""")
def q_dedupe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The post-processing dedupe with its real key (dataset, subset,
    method, hyperparameters, metric) over the records fixture."""
    r = final_records(spark, sf_dir)
    return (D.dedupe_conflicting(r, order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
            .select(*_FINAL_KEYS.split(", ")))


# ------------------------------------------------------------ prompts
_PROMPT_TEMPLATE = ("Turn {{TURN}} of conversation {{CONV}} by {{ROLE}}:\n{{TEXT}}\n"
                    "Is this a leaderboard table? Answer true or false.")
_PROMPT_SQL = ("replace(replace(replace(replace('" + _PROMPT_TEMPLATE.replace("\n", "' || chr(10) || '")
               + "', '{{TURN}}', CAST(turn AS STRING)), '{{CONV}}', CAST(conv_id AS STRING)), "
               "'{{ROLE}}', role), '{{TEXT}}', text)")


@register("render_prompt", f"""
SELECT conv_id, turn, md5({_PROMPT_SQL}) AS prompt_md5, length({_PROMPT_SQL}) AS prompt_chars
FROM conversations
""")
def q_render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    p = A.render_prompt(_PROMPT_TEMPLATE, {"TURN": F.col("turn").cast("string"),
                                           "CONV": F.col("conv_id").cast("string"),
                                           "ROLE": F.col("role"), "TEXT": F.col("text")})
    return c.select("conv_id", "turn", F.md5(p).alias("prompt_md5"),
                    F.length(p).cast("bigint").alias("prompt_chars"))


@register("chat_wrap", f"""
SELECT conv_id, turn, md5(concat('User: ', text, chr(10), 'Assistant:')) AS plain_md5,
       'user' AS first_role, length(text) AS content_chars
FROM conversations
""")
def q_chat_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    msgs = A.chat_wrap(F.col("text"))
    return c.select("conv_id", "turn", F.md5(A.plain_chat("text")).alias("plain_md5"),
                    msgs[0]["role"].alias("first_role"),
                    F.length(msgs[0]["content"]).cast("bigint").alias("content_chars"))


@register("truncate_prompt", """
SELECT doc_id, md5(substring(text, 1, 10000)) AS prompt_md5,
       length(substring(text, 1, 10000)) AS prompt_chars
FROM documents
""")
def q_truncate_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    t = A.truncate_chars("text", 10000)
    return d.select("doc_id", F.md5(t).alias("prompt_md5"), F.length(t).cast("bigint").alias("prompt_chars"))


_BUDGET = 300


@register("truncate_prompt_tokens", rf"""
SELECT doc_id, md5(p) AS prompt_md5, length(p) AS prompt_chars FROM (
  SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > {_BUDGET}
    THEN regexp_extract(text, '^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{_BUDGET - 1}}}[^\x20\x09-\x0D]+', 0)
    ELSE text END AS p
  FROM documents)
""")
def q_truncate_prompt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut to 300 words by the word tokenizer."""
    from ..operators.prompts import truncate_prompt_tokens
    d = read(spark, sf_dir, "documents").select("doc_id", truncate_prompt_tokens("text", _BUDGET).alias("p"))
    return d.select("doc_id", F.md5("p").alias("prompt_md5"), F.length("p").cast("bigint").alias("prompt_chars"))


_LABEL_ANSWER_SQL = ("CASE WHEN quality = 1 AND toxic = 0 THEN 'True' "
                     "WHEN quality = 1 THEN 'Answer: TRUE, mostly' "
                     "WHEN toxic = 1 THEN 'false' ELSE 'Not relevant.' END")


@register("label_is_true", f"""
SELECT doc_id FROM labels WHERE contains(lower({_LABEL_ANSWER_SQL}), 'true')
""")
def q_label_is_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels").select("doc_id", F.expr(_LABEL_ANSWER_SQL).alias("answer"))
    return lab.filter(A.label_is_true("answer")).select("doc_id")


_YNU_SQL = ("CASE (quality + 2 * toxic) WHEN 0 THEN 'No. The paper has no results.' "
            "WHEN 1 THEN '**Yes** - it reports a leaderboard.' "
            "WHEN 2 THEN 'unclear: the pdf is cut' ELSE 'Maybe later' END")


@register("yes_no_unclear", f"""
SELECT doc_id,
  CASE (quality + 2 * toxic) WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' WHEN 2 THEN 'Unclear' END AS label,
  CASE (quality + 2 * toxic) WHEN 0 THEN '. The paper has no results.'
       WHEN 1 THEN '** - it reports a leaderboard.' WHEN 2 THEN ': the pdf is cut' END AS justification
FROM labels
""")
def q_yes_no_unclear(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels").select("doc_id", F.expr(_YNU_SQL).alias("answer"))
    r = A.yes_no_unclear("answer")
    return lab.select("doc_id", r["label"].alias("label"), r["justification"].alias("justification"))


@register("complete_rows", f"""
SELECT {_FINAL_KEYS} FROM (SELECT {_FINAL_KEYS}, {_FINAL_SELECT} FROM lineitem)
WHERE dataset_name IS NOT NULL AND model_name IS NOT NULL AND metric IS NOT NULL
""")
def q_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.complete_rows(final_records(spark, sf_dir)).select(*_FINAL_KEYS.split(", "))


@register("distinct_keys", f"""
SELECT DISTINCT dataset_name, subset FROM (SELECT {_FINAL_SELECT} FROM lineitem)
""")
def q_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.summary import distinct_keys
    return distinct_keys(final_records(spark, sf_dir), ["dataset_name", "subset"])


@register("distinct_papers", f"""
SELECT count(DISTINCT paper_id) AS n_papers
FROM (SELECT {_FINAL_SELECT} FROM lineitem) WHERE NOT contains(coalesce(dataset_description, ''), '<FAILED>')
""")
def q_distinct_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.summary import distinct_papers
    r = final_records(spark, sf_dir)
    return distinct_papers(r.filter(~F.contains(F.coalesce("dataset_description", F.lit("")),
                                                F.lit("<FAILED>"))))


@register("sorted_inputs", """
SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderpriority, o_orderstatus,
       CAST(o_custkey % 7 AS VARCHAR)])), '|') AS sorted_terms
FROM orders
""")
def q_sorted_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected terms are reported sorted (``sort_array``)."""
    o = read(spark, sf_dir, "orders")
    terms = F.array_sort(F.array_distinct(F.array("o_orderpriority", "o_orderstatus",
                                                  (F.col("o_custkey") % 7).cast("string"))))
    return o.select("o_orderkey", F.array_join(terms, "|").alias("sorted_terms"))


@register("sorted_paths", """
SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS "rank" FROM pages
""")
def q_sorted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page paths in order, with gapless ranks."""
    from ..operators.ordering import sorted_inputs
    return sorted_inputs(read(spark, sf_dir, "pages").select("url", "page_id"), ["url", "page_id"])


@register("final_projection", "SELECT concat('o', CAST(l_orderkey AS VARCHAR)) AS table_source_arxiv_id, "
          "'T' AS table_source, " + RECORD_SQL["dataset"] + " AS dataset_name, '' AS dataset_reference_arxiv_id, "
          "'GPT4o' AS dataset_description_source, 'D' AS dataset_description, "
          + RECORD_SQL["subset"] + " AS subset, " + RECORD_SQL["base_model"] + " AS model_name, "
          + RECORD_SQL["hyperparameters"] + " AS hyperparameters, " + RECORD_SQL["pref_tuning_method"]
          + " AS pref_tuning_method, " + RECORD_SQL["metric"] + " AS metric, "
          "CAST(CAST(l_quantity AS DECIMAL(12,2)) AS DOUBLE) AS metric_value "
          f"FROM lineitem WHERE NOT {_FAILED_ORDER}")
def q_final_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records → the final columns (the nested record itself is left out
    of the comparison)."""
    a = extract_records(order_answers(spark, sf_dir), "table_results_raw", "ans")
    flat = flatten_records(parse_jsonl_records(a, "ans")).select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("paper_id"),
        F.lit("T").alias("table_source"), "record", F.lit("").alias("dataset_link"),
        F.lit("GPT4o").alias("description_source"), F.lit("D").alias("dataset_description"),
        F.col("record.metric").alias("standardized_metric"),
        F.col("record.value").try_cast("double").alias("adjusted_metric_value"))
    return D.final_projection(flat).drop("original_extracted_dictionary")
