"""Queries for block structure: labels, multi-tabular blocks, spans,
brace checks, containment and command snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import (balanced_spans, braces_balanced, drop_contained_blocks,
                                raw_table_blocks, repair_block, strip_line_comments)
from ..operators.cells import numeric_cell_spans, table_cells
from ..operators.labels import resolve_table_label, split_multi_tabular, table_labels
from .q_tables import order_tables
from .queries import read, register
from .render import sql_template

# ------------------------------------------------------------ RT-MULTI
# One block per order, by orderkey % 4: 0 one tabular + one label; 1 two
# tabulars + one block label; 2 two \subfloat each with its own label;
# 3 one tabular with two labels.
_K = "{{o_orderkey}}"
_TAB = "\\begin{tabular}{c}\n" + _K + " & {{o_custkey}} \\\\\n\\end{tabular}"
_TAB2 = "\\begin{tabular}{cc}\n{{o_custkey}} & " + _K + " \\\\\n\\end{tabular}"
_MULTI_TEMPLATES = {
    0: "\\begin{table}\n" + _TAB + "\n\\label{tab:o" + _K + "}\n\\end{table}",
    1: "\\begin{table}\n" + _TAB + "\n" + _TAB + "\n\\label{tab:m" + _K + "}\n\\end{table}",
    2: ("\\begin{table}\n\\subfloat[a]{\\label{tab:a" + _K + "}" + _TAB + "}\n"
        "\\subfloat[b]{\\label{tab:b" + _K + "}" + _TAB2 + "}\n\\end{table}"),
    3: "\\begin{table}\n" + _TAB + "\n\\label{tab:x" + _K + "}\\label{tab:y" + _K + "}\n\\end{table}",
}


def _multi_sql(duck: bool) -> str:
    cases = " ".join(f"WHEN {k} THEN {sql_template(t, duck)}" for k, t in _MULTI_TEMPLATES.items())
    return f"CASE o_orderkey % 4 {cases} END"


@register("split_multi_tabular", r"""
SELECT o_orderkey, i AS piece_index,
  CASE o_orderkey % 4
    WHEN 0 THEN concat(chr(92), 'label{tab:o', CAST(o_orderkey AS VARCHAR), '}')
    WHEN 1 THEN concat(chr(92), 'label{tab:m', CAST(o_orderkey AS VARCHAR), '}')
    WHEN 2 THEN concat(CASE i WHEN 0 THEN 'tab:a' ELSE 'tab:b' END, CAST(o_orderkey AS VARCHAR))
    ELSE concat(chr(92), 'label{tab:x', CAST(o_orderkey AS VARCHAR), '}') END AS label,
  1 AS n_tabular
FROM orders, (SELECT unnest([0, 1]) AS i)
WHERE i = 0 OR o_orderkey % 4 IN (1, 2)
""")
def q_split_multi_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_multi_sql(False)).alias("table_source"))
    o = o.withColumn("all_tables", F.array("table_source"))
    pieces = split_multi_tabular(o)
    return pieces.select("o_orderkey", "piece_index", "label",
                         F.regexp_count("piece", F.lit(r"\\begin\{tabular")).cast("int").alias("n_tabular"))


# References in the text around a block: every second pair of labels is cited
# by its second label, twice.
_REFS = {
    6: " see \\ref{tab:b" + _K + "} and \\ref{tab:b" + _K + "}\n",
    7: " see \\ref{tab:y" + _K + "} and \\ref{tab:y" + _K + "}\n",
}
_RESOLVED_SQL = """concat(chr(92), 'label{tab:', CASE o_orderkey % 8
    WHEN 6 THEN 'b' WHEN 7 THEN 'y' WHEN 2 THEN 'a' WHEN 3 THEN 'x'
    WHEN 0 THEN 'o' WHEN 4 THEN 'o' ELSE 'm' END, CAST(o_orderkey AS VARCHAR), '}')"""


def labelled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, b (block), paper (block after its references)."""
    refs = " ".join(f"WHEN {k} THEN {sql_template(t)}" for k, t in _REFS.items())
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(_multi_sql(False)).alias("b"),
        F.expr(f"CASE o_orderkey % 8 {refs} ELSE ' see the table ' END").alias("refs"))
    return o.select("o_orderkey", "b", F.concat("refs", "b").alias("paper"))


@register("table_labels", f"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS n_labels,
  {_RESOLVED_SQL} AS label
FROM orders
""")
def q_table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels per block, and the one that the text refers to most (ties:
    the first)."""
    o = labelled_blocks(spark, sf_dir)
    return o.select("o_orderkey", F.size(table_labels(F.col("b"))).alias("n_labels"),
                    resolve_table_label(F.col("b"), F.col("paper"), F.col("b")).alias("label"))


@register("resolve_table_label", r"""
SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN concat(chr(92), 'label{tab:o', CAST(o_orderkey AS VARCHAR), '}')
    WHEN 1 THEN concat(chr(92), 'label{tab:m', CAST(o_orderkey AS VARCHAR), '}') END AS tabular_label,
  """ + _RESOLVED_SQL + """ AS block_label
FROM orders
""")
def q_resolve_table_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tabular without a label takes the only label of its block; a block
    with several takes the most referenced."""
    from ..operators.blocks import tabular_spans
    o = labelled_blocks(spark, sf_dir).withColumn("t", F.get(tabular_spans("b"), F.lit(0)))
    return o.select("o_orderkey",
                    resolve_table_label(F.col("t"), F.col("paper"), F.col("b"), F.col("b")).alias("tabular_label"),
                    resolve_table_label(F.col("b"), F.col("paper"), F.col("b"), F.col("b")).alias("block_label"))


@register("numeric_cell_spans", """
SELECT l_orderkey, count(*) * 3 + CASE WHEN l_orderkey % 8 = 7 THEN 2 ELSE 0 END AS n_spans,
       CAST(0 AS BIGINT) AS n_bad, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS sum_qty
FROM lineitem GROUP BY l_orderkey
""")
def q_numeric_cell_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of numeric cells; every span must cut exactly its text out
    of the tabular code."""
    t = order_tables(spark, sf_dir)
    from ..operators.blocks import tabular_spans
    cells = t.select("l_orderkey", F.explode(tabular_spans("table_source")).alias("tabular_code"))
    s = cells.select("l_orderkey", "tabular_code", F.explode(numeric_cell_spans("tabular_code")).alias("s"))
    code = F.col("tabular_code")
    bad = ((F.substr(code, F.col("s.value_start") + 1, F.col("s.value_end") - F.col("s.value_start"))
            != F.col("s.value"))
           | (F.substr(code, F.col("s.raw_start") + 1, F.col("s.raw_end") - F.col("s.raw_start"))
              != F.col("s.raw")))
    qty = F.when(F.col("s.raw").rlike(r"\\textbf|\\multirow|\\pm"), F.col("s.value").try_cast("decimal(18,2)"))
    return s.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_spans"),
                                       F.count_if(bad).alias("n_bad"),
                                       F.sum(qty).cast("decimal(18,2)").alias("sum_qty"))


@register("brace_balance_check", """
SELECT l_orderkey, l_orderkey % 8 <> 6 AS balanced FROM (SELECT DISTINCT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, true AS balanced FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey % 8 = 5
""")
def q_brace_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw blocks (a ``figure`` and the ``table`` in it are two): the kind-6
    caption is unbalanced until repaired."""
    from .render import lineitem_papers
    p = lineitem_papers(read(spark, sf_dir, "lineitem"))
    b = p.select("l_orderkey", F.explode(raw_table_blocks(F.col("full_paper_latex_code"))).alias("b"))
    return b.select("l_orderkey", braces_balanced(strip_line_comments(F.col("b"))).alias("balanced"))


@register("brace_balance_repair", """
SELECT l_orderkey, true AS balanced, CASE WHEN l_orderkey % 8 = 6 THEN 1 ELSE 0 END AS extended
FROM (SELECT DISTINCT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, true AS balanced, 0 AS extended FROM (SELECT DISTINCT l_orderkey FROM lineitem)
WHERE l_orderkey % 8 = 5
""")
def q_brace_balance_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .render import lineitem_papers
    p = lineitem_papers(read(spark, sf_dir, "lineitem"))
    text = F.col("full_paper_latex_code")
    b = p.select("l_orderkey", "full_paper_latex_code",
                 F.explode(raw_table_blocks(text)).alias("b"))
    fixed = repair_block(strip_line_comments(F.col("b")), text)
    return b.select("l_orderkey", braces_balanced(fixed).alias("balanced"),
                    F.when(F.length(fixed) > F.length(strip_line_comments(F.col("b"))), 1)
                     .otherwise(0).alias("extended"))


@register("drop_contained_blocks", """
SELECT l_orderkey, CASE WHEN l_orderkey % 8 = 5 THEN 2 ELSE 1 END AS n_raw, 1 AS n_kept
FROM (SELECT DISTINCT l_orderkey FROM lineitem)
""")
def q_drop_contained_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``figure`` around a ``table`` yields two raw blocks, one kept."""
    from .render import lineitem_papers
    p = lineitem_papers(read(spark, sf_dir, "lineitem"))
    raw = raw_table_blocks(F.col("full_paper_latex_code"))
    return p.select("l_orderkey", F.size(raw).alias("n_raw"),
                    F.size(drop_contained_blocks(raw)).alias("n_kept"))


@register("balanced_spans", """
SELECT l_orderkey, 1 AS n_tabulars, CASE WHEN l_orderkey % 8 = 4 THEN 2 ELSE 1 END AS n_begin
FROM (SELECT DISTINCT l_orderkey FROM lineitem)
""")
def q_balanced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outermost tabulars: the nested header tabular stays inside."""
    t = order_tables(spark, sf_dir)
    spans = balanced_spans(F.col("table_source"))
    return t.select("l_orderkey", F.size(spans).alias("n_tabulars"),
                    F.regexp_count(spans[0], F.lit(r"\\begin\{tabular")).cast("int").alias("n_begin"))


@register("command_snippets", r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 2 ELSE 0 END AS n_snippets,
       CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE 0 END AS first_has_label
FROM orders
""")
def q_command_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``\\subfloat{…}`` snippets of the multi-tabular blocks."""
    from ..operators.blocks import command_snippets
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_multi_sql(False)).alias("b"))
    s = command_snippets(F.col("b"), "subfloat")
    first_ok = F.when(F.size(s) > 0, F.when(
        F.startswith(s[0], F.lit("\\subfloat[a]{\\label{tab:a")) & F.endswith(s[0], F.lit("\\end{tabular}}")),
        1).otherwise(0)).otherwise(0)
    return o.select("o_orderkey", F.size(s).alias("n_snippets"), first_ok.alias("first_has_label"))


@register("tables_by_numeric_content", r"""
SELECT l_orderkey, CAST(sum(n_without) AS INTEGER) AS n_without_numeric, CAST(sum(n_with) AS INTEGER) AS n_with_numeric
FROM (SELECT DISTINCT l_orderkey, 0 AS n_without, 1 AS n_with FROM lineitem
      UNION ALL
      SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END,
             CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END FROM orders)
GROUP BY l_orderkey
""")
def q_tables_by_numeric_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both selections, counted by order, over the tables of all line items
    (numbers in each) and one more table an order: of words (0), of words and a
    caption number outside the cells (1), with a marked number (2), plain (3)."""
    from ..operators.cells import tables_by_numeric_content
    k = F.col("o_orderkey") % 4
    cell = (F.when(k == 2, F.concat(F.lit("\\textbf{"), F.col("o_custkey").cast("string"), F.lit("}")))
            .when(k == 3, F.col("o_totalprice").cast("decimal(12,2)").cast("string")).otherwise(F.lit("open")))
    number = F.when(k == 1, F.col("o_custkey").cast("string")).otherwise(F.lit("none"))
    table = F.concat(F.lit("\\begin{table}\n\\caption{No "), number, F.lit("}\n\\begin{tabular}{ll}\nname & value \\\\\n"),
                     F.col("o_orderstatus"), F.lit(" & "), cell, F.lit(" \\\\\n\\end{tabular}\n\\end{table}"))
    one = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), table.alias("table_source"))
    t = order_tables(spark, sf_dir).select("l_orderkey", "table_source").unionByName(one)
    found = (tables_by_numeric_content(t).select("l_orderkey", F.lit(False).alias("numeric"))
             .unionByName(tables_by_numeric_content(t, keep_numeric=True).select("l_orderkey", F.lit(True).alias("numeric"))))
    return found.groupBy("l_orderkey").agg(F.count_if(~F.col("numeric")).cast("int").alias("n_without_numeric"),
                                           F.count_if("numeric").cast("int").alias("n_with_numeric"))


@register("nearest_label_after", r"""
SELECT o_orderkey, i AS tabular_index,
  CASE o_orderkey % 4
    WHEN 0 THEN concat(chr(92), 'label{tab:o', CAST(o_orderkey AS VARCHAR), '}')
    WHEN 1 THEN CASE i WHEN 0 THEN NULL ELSE concat(chr(92), 'label{tab:m', CAST(o_orderkey AS VARCHAR), '}') END
    WHEN 2 THEN CASE i WHEN 0 THEN concat(chr(92), 'label{tab:b', CAST(o_orderkey AS VARCHAR), '}') ELSE NULL END
    ELSE concat(chr(92), 'label{tab:x', CAST(o_orderkey AS VARCHAR), '}') END AS label
FROM orders, (SELECT unnest([0, 1]) AS i)
WHERE i = 0 OR o_orderkey % 4 IN (1, 2)
""")
def q_nearest_label_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.labels import nearest_label_after
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_multi_sql(False)).alias("b"))
    return o.select("o_orderkey", F.posexplode(nearest_label_after(F.col("b"))).alias("tabular_index", "label"))


@register("most_referenced", f"SELECT o_orderkey, {_RESOLVED_SQL} AS label FROM orders")
def q_most_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a table's labels, the one referenced most often in the paper outside
    the tables (ties: the first)."""
    from ..operators.labels import most_referenced
    o = labelled_blocks(spark, sf_dir)
    return o.select("o_orderkey", most_referenced(table_labels(F.col("b")), F.col("paper"), F.col("b")).alias("label"))
