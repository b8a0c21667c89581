"""Cases that the rendered tables do not hold: deep nesting, long names, broken
bytes, NULL and malformed values, equal pieces, one call per key."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tablemine.functions.numeric import numeric_value_lenient, numeric_value_strict
from tablemine.operators.assembly import expand_macros, resolve_includes, select_main_files
from tablemine.operators.bib import bib_title_lookup
from tablemine.operators.dedupe import dedupe_conflicting, expect_subset_section
from tablemine.operators.describe import fill_failed_descriptions
from tablemine.operators.labels import resolve_table_label, split_multi_tabular
from tablemine.operators.model import apply_model
from tablemine.sources.datasets import read_shards, write_shards
from tablemine.sources.files import scan_paper_tree


def test_cells_nested_to_any_depth(spark):
    cells = [("\\textbf{" * n + "5" + "}" * n,) for n in (0, 1, 4, 5, 8, 12, 30)]
    df = spark.createDataFrame(cells, "c string")
    got = df.select(numeric_value_lenient("c").alias("a"), numeric_value_strict("c").alias("b")).collect()
    assert all((r.a, r.b) == ("5", "5") for r in got)


def test_long_include_names_and_both_main_files(spark):
    name = "n" * 110
    files = spark.createDataFrame([
        ("p", "main.tex", f"\\begin{{document}}\n\\input{{{name}}}\n\\end{{document}}"), ("p", f"{name}.tex", "LONG"),
        ("p", "alt.tex", "\\begin{document}\n\\include{x/y}\n\\end{document}"), ("p", "y.tex", "Y"), ("p", "fig.png", None),
        ("q", "only.tex", "\\begin{document}\n\\input{gone}\n\\end{document}")],
        "paper_id string, rel_path string, content string")
    out = {(r.paper_id, r.rel_path): r.text for r in resolve_includes(select_main_files(files), files).collect()}
    assert out["p", "main.tex"] == "\\begin{document}\n\nLONG\n\n\\end{document}"
    assert out["p", "alt.tex"] == "\\begin{document}\n\nY\n\n\\end{document}"
    assert out["q", "only.tex"] == "\\begin{document}\n\\input{gone}\n\\end{document}"


def test_macro_bodies_of_any_length(spark):
    text = "\\newcommand{\\m}{\\a\\b\\c\\d\\e}\n\\begin{document}\\m{}\\end{document}"
    df = spark.createDataFrame([(text,)], "t string")
    a, b = df.select(expand_macros("t"), expand_macros("t", max_backslashes=3)).first()
    assert "}\\a\\b\\c\\d\\e\\end" in a and "}\\m{}\\end" in b


def test_titles_far_down_and_of_other_entries(spark):
    bib = ("@book{a,\n" + " x = {1},\n" * 30 + " title = {Far}\n}\n  @misc{b}\n@misc{c,\n booktitle = {No},\n title={C {x}},\n}\n"
           "text\n@misc {d ,\ntitle = {D}\n}\n% @misc{e,\n% title={E}}\n")
    files = spark.createDataFrame([("p", "r.bib", bib)], "paper_id string, rel_path string, content string")
    cites = spark.createDataFrame([("p", t) for t in "abcde"] + [("q", "a")], "paper_id string, dataset_citation_tag string")
    got = {(r.paper_id, r.tag): r.title for r in bib_title_lookup(files, cites).collect()}
    assert got == {("p", "a"): "Far", ("p", "b"): None, ("p", "c"): "C {x}", ("p", "d"): "D", ("p", "e"): None, ("q", "a"): None}


def test_source_files_with_broken_bytes(spark):
    paper = os.path.join(root := tempfile.mkdtemp(prefix="tablemine-bytes-"), "arxiv_src_2023", "2301.1")
    os.makedirs(paper)
    for name, data in (("main.tex", b"caf\xe9 \xef\xbf\xbd ok \xc3\xa9"), ("part_tex", b"x"), ("fig.pdf", b"\xff\xfe\x00"), ("r.bib", b"@")):
        with open(os.path.join(paper, name), "wb") as f:
            f.write(data)
    got = {r.rel_path: r.content for r in scan_paper_tree(spark, root, ["arxiv_src_2023"]).collect()}
    assert got == {"main.tex": "caf \ufffd ok é", "part_tex": "x", "r.bib": "@"}


def test_conflicts_with_null_and_malformed_values(spark):
    rows = [("null-and-number", None), ("null-and-number", None), ("null-and-number", "7"), ("nulls", None), ("nulls", None),
            ("bad-and-number", "x7"), ("bad-and-number", "7"), ("bad", "x"), ("same", "7"), ("same", "7.0"), ("differ", "1"), ("differ", "2")]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v string, i int")
    got = {r.k: r.i for r in dedupe_conflicting(df, ["k"], "v", ["i"]).collect()}
    assert got == {"nulls": 3, "bad": 7, "same": 8}


def test_expectation_stops_the_job(spark):
    good = spark.createDataFrame([("xx", "d"), ("s", "a Subset Description b"), (None, None)], "subset string, dataset_description string")
    assert expect_subset_section(good).count() == 3
    with pytest.raises(Exception, match="subset without Subset Description"):
        expect_subset_section(good.union(spark.createDataFrame([("s", "none")], good.schema))).select("subset").collect()


def test_equal_tabulars_keep_their_pieces(spark):
    tab = "\\begin{tabular}{c}\n1\n\\end{tabular}"
    block = f"\\subfloat[a]{{\\label{{A}}{tab}}}\n\\subfloat[b]{{\\label{{B}}{tab}}}"
    df = spark.createDataFrame([(block, [block])], "table_source string, all_tables array<string>")
    got = [(r.piece, r.label) for r in split_multi_tabular(df).orderBy("piece_index").collect()]
    assert got == [(f"\\subfloat[a]{{\\label{{A}}{tab}", "A"), (f"\\subfloat[b]{{\\label{{B}}{tab}", "B")]


def test_label_of_the_enclosing_block(spark):
    df = spark.createDataFrame([("t", "t \\label{x}"), ("t", "\\label{x}\\label{y}"), ("t", "none"), ("\\label{z}", "\\label{x}")],
                               "t string, b string")
    got = [r[0] for r in df.select(resolve_table_label("t", "b", "t", "b")).collect()]
    assert got == ["\\label{x}", None, None, "\\label{z}"]


def test_one_model_call_per_failed_key(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def model(prompts):
            calls.add(len(prompts))
            return [p.split("Source: ")[1].split("\n")[0] for p in prompts]
        return model

    df = spark.createDataFrame([("d", "xx", f"p{i:03}", "", "<FAILED>", "<FAILED>") for i in range(200)] + [("ok", "xx", "p", "", "fine", "m")],
                               "dataset string, subset string, paper_id string, dataset_link string, dataset_description string, description_source string")
    texts = spark.createDataFrame([(f"p{i:03}", "t") for i in range(200)], "paper_id string, text string")
    out = fill_failed_descriptions(df, texts, factory).collect()
    assert {(r.dataset, r.dataset_description) for r in out} == {("d", "p199"), ("ok", "fine")}
    assert calls.value == 1


def test_model_gets_bounded_batches(spark):
    df = spark.range(25).select(F.col("id").cast("string").alias("p"))
    got = apply_model(df.repartition(1), "p", lambda: lambda ps: [str(len(ps))] * len(ps), max_records_per_batch=10).collect()
    assert sorted(int(r.answer) for r in got) == [5] * 5 + [10] * 20


def test_shards_in_one_write(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tablemine-shards-"), "s")
    write_shards(spark.range(100), path, 4, "id")
    assert sum(d.startswith("shard=") for d in os.listdir(path)) == 4
    assert read_shards(spark, path).columns == ["id"] and read_shards(spark, path).count() == 100
