"""Block extraction, balanced spans, containment, repair, cells."""

from pyspark.sql import functions as F

from tablemine.operators.blocks import (balanced_spans, drop_contained_blocks, repair_block,
                                        strip_line_comments, table_blocks)
from tablemine.operators.cells import numeric_cells, table_cells
from conftest import one_col

T = "\\begin{tabular}{c}\n1 \\\\\n\\end{tabular}"


def test_balanced_spans(spark):
    nested = "\\begin{tabular}{c}x\\begin{tabular}{c}y\\end{tabular}\\end{tabular}"
    two = T + " mid " + T
    end_first = "\\end{tabular}" + T + "\\begin{tabular}{c}"
    unclosed = "\\begin{tabular}{c} x"
    df = one_col(spark, [nested, two, end_first, unclosed, "no table"])
    got = [r.s for r in df.select(balanced_spans(F.col("c")).alias("s")).collect()]
    assert got == [[nested], [T, T], [], [], []]


def test_drop_contained_keeps_equal_copies(spark):
    df = spark.createDataFrame([(["ab", "abc", "ab", "x"],)], "a array<string>")
    got = df.select(drop_contained_blocks(F.col("a")).alias("r")).collect()[0].r
    assert got == ["abc", "x"]
    df = spark.createDataFrame([(["ab", "ab"],)], "a array<string>")
    assert df.select(drop_contained_blocks(F.col("a"))).collect()[0][0] == ["ab", "ab"]


def test_strip_line_comments(spark):
    df = one_col(spark, ["a % c\nb \\% keep % tail\nc \\\\% cut"])
    got = df.select(strip_line_comments(F.col("c"))).collect()[0][0]
    assert got == "a \nb \\% keep % tail\nc \\\\"


def test_repair_extends_to_balance(spark):
    paper = "\\begin{table}\\caption{x " + T + "\\end{table} more} tail"
    block = "\\begin{table}\\caption{x " + T + "\\end{table}"
    df = spark.createDataFrame([(block, paper)], "b string, p string")
    got = df.select(repair_block(F.col("b"), F.col("p"))).collect()[0][0]
    assert got == block + " more}"


def test_figure_wrapped_table_is_one_block(spark):
    paper = "\\begin{figure}\n\\begin{table}\n" + T + "\n\\end{table}\n\\end{figure}"
    df = one_col(spark, [paper])
    got = df.select(table_blocks(F.col("c"))).collect()[0][0]
    assert got == [paper]


def test_cells_and_numeric(spark):
    block = ("\\begin{table}\\begin{tabular}{ccc}\n\\toprule\nname & a & b \\\\\n\\midrule\n"
             "x & \\textbf{1.5} & 7b \\\\\ny & 2 & $3 \\pm 1$ \\\\\n\\bottomrule\n\\end{tabular}\\end{table}")
    t = spark.createDataFrame([(1, block)], "id long, table_source string")
    cells = table_cells(t, keep_cols=["id"])
    assert cells.count() == 9
    lenient = {(r.row_index, r.col_index): r.value for r in numeric_cells(cells).collect()}
    assert lenient == {(1, 1): "1.5", (1, 2): "7b", (2, 1): "2", (2, 2): "3"}
    strict = {(r.row_index, r.col_index) for r in numeric_cells(cells, grammar="strict").collect()}
    assert strict == {(1, 1), (2, 1), (2, 2)}


def test_command_snippets(spark):
    from tablemine.operators.blocks import command_snippets
    text = ("\\subfloat[a]{\\label{x}" + T + "} mid \\subfloat{no end here} "
            "\\subfloat{" + T + "")
    df = one_col(spark, [text])
    got = df.select(command_snippets(F.col("c"), "subfloat")).collect()[0][0]
    assert got == ["\\subfloat[a]{\\label{x}" + T + "}"]


def test_nearest_label_after(spark):
    from tablemine.operators.labels import nearest_label_after
    block = T + "\n" + T + "\n\\label{b}\n" + T + "\\label{c}\\label{d}"
    df = one_col(spark, [block])
    got = df.select(nearest_label_after(F.col("c"))).collect()[0][0]
    assert got == [None, "\\label{b}", "\\label{c}"]
