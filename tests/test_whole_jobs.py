"""Queries over the whole of the tables they name, on rows made here."""

import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E


def folder(spark, **tables):
    """A folder of tables from rows: name=(schema, rows)."""
    at = tempfile.mkdtemp()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double"


def test_tables_by_numeric_content_reads_line_items(spark):
    at = folder(spark, lineitem=(LINES, [(k, 10 + k, 3, n, 2.5) for k in range(1, 9) for n in (1, 2)]),
                orders=(ORDERS, [(k, 7, "O", "1-URGENT", 9.5) for k in range(1, 5)]))
    got = {r.l_orderkey: (r.n_without_numeric, r.n_with_numeric)
           for r in E.queries()["tables_by_numeric_content"](spark, at).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (0, 2), 4: (1, 1), 5: (0, 1), 6: (0, 1), 7: (0, 1), 8: (0, 1)}


def test_tree_stands_on_disk_in_parts(spark, monkeypatch):
    import os

    from tablemine.plans import q_sources
    from tablemine.sources import files
    at = folder(spark, orders=(ORDERS, [(k, k % 9, "O", "1-URGENT", 9.5) for k in range(60)]))
    monkeypatch.setattr(q_sources, "TREE_FILES", 20, raising=False)
    seen, scan = [], files.scan_paper_tree

    def counted(spark, root, *args):
        seen.append((root, sum(len(found) for _, _, found in os.walk(root.removeprefix("file:")))))
        return scan(spark, root, *args)
    monkeypatch.setattr(files, "scan_paper_tree", counted)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    rows = {r.paper_id: (r.year, r.n_files, r.n_nested) for r in E.queries()["scan_paper_tree"](spark, at).collect()}
    want = {c: [k for k in range(60) if k % 9 == c] for c in range(9)}
    assert rows == {f"c{c}-0": ("arxiv_src_2023" if c % 2 == 0 else "arxiv_src_2024",
                                sum(k % 6 < 4 for k in ks) + 2 + (c % 5 == 0), sum(k % 6 == 2 for k in ks)) for c, ks in want.items()}
    assert sum(n for _, n in seen) == sum(n for _, n, _ in rows.values()) and max(n for _, n in seen) < 40
    assert not any(os.path.exists(root.removeprefix("file:")) for root, _ in seen)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_costly_columns_are_made_once(spark):
    """No filter that Spark infers makes blocks or records a second time."""
    at = folder(spark, lineitem=(LINES + ", l_returnflag string", [(k, 10 + k, 3, 1, 2.5, "A") for k in range(1, 9)]))
    for name, call in (("numeric_cells", "regexp_extract_all"), ("flatten_records", "from_json")):
        plan = E.queries()[name](spark, at)._jdf.queryExecution().optimizedPlan()
        filters = [str(n) for n in (plan.p(i) for i in range(200)) if n is not None and n.nodeName() == "Filter"]
        assert filters and not any(call in f for f in filters)


def test_archives_are_written_in_a_stream(spark):
    import os
    import tarfile

    from tablemine.plans.render import write_archives
    at = tempfile.mkdtemp()
    rows = [(f"c{k}-0", name, text) for k in range(5) for name, text in (("main.tex", f"é{k}"), ("sec/a.tex", None), ("a.tex", "y"), ("a.tex", "x"))]
    done = write_archives(spark.createDataFrame(rows, "paper_id string, rel_path string, content string"), at)
    assert "FlatMapGroups" not in done._jdf.queryExecution().executedPlan().toString()
    sizes = {r.paper_id: r.bytes for r in done.collect()}
    assert sizes == {f"c{k}-0": os.path.getsize(f"{at}/c{k}-0.tar.gz") for k in range(5)}
    with tarfile.open(f"{at}/c3-0.tar.gz") as tar:
        assert [(m.name, tar.extractfile(m).read()) for m in tar] == [
            ("a.tex", b"x"), ("a.tex", b"y"), ("main.tex", "é3".encode()), ("sec/a.tex", b"")]


def test_model_column_runs_once_per_row_and_keeps_other_columns_out_of_python(spark):
    from tablemine.operators.model import apply_model
    df = spark.range(20).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("p"))
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def model(prompts):
            calls.add(len(prompts))
            return [None if p == "p3" else p + "!" for p in prompts]
        return model
    out = apply_model(df, "p", factory, "a")
    used = out.filter("a <> 'p4!'").withColumn("b", F.concat("a", "a")).filter("b <> 'p5!p5!'")
    assert {r.id: r.a for r in used.collect()} == {i: f"p{i}!" for i in range(20) if i not in (3, 4, 5)}
    assert calls.value == 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython [answer(p" in plan


def test_strip_ws_takes_every_unicode_blank_from_the_ends_only(spark):
    from tablemine.functions.common import count_sub, strip_ws
    blanks = "\t\n\x0b\x0c\r \x85\xa0      　"
    rows = [(blanks + "a" + blanks + "b" + blanks,), (blanks,), ("",), (None,), ("​a﻿",)]
    df = spark.createDataFrame(rows, "v string")
    got = [r[0] for r in df.select(strip_ws(F.col("v"))).collect()]
    assert got == ["a" + blanks + "b", "", "", None, "​a﻿"]
    old = [r[0] for r in df.select(F.regexp_replace("v", r"(?U)^\s+|\s+$", "")).collect()]
    assert got == old
    n = spark.createDataFrame([("aaaa",), ("xaax",), ("",), (None,)], "v string").select(count_sub(F.col("v"), "aa")).collect()
    assert [r[0] for r in n] == [2, 1, 0, None]


def test_rendered_papers_join_by_paper_without_moving_again(spark):
    from tablemine.plans.render import lineitem_papers
    li = spark.range(600).select(
        (F.col("id") % 40).alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"), F.lit(3.0).alias("l_quantity"))
    papers = lineitem_papers(li, noise=False)
    both = papers.select("paper_id", "l_orderkey").hint("merge").join(papers.select("paper_id", "full_paper_latex_code"), "paper_id")
    plan = both._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    assert "hashpartitioning(paper_id" in join and "hashpartitioning(l_orderkey" not in join.split("BroadcastExchange")[0]
    assert both.count() == 40


def test_lookup_copies_the_table_for_hot_keys_only(spark):
    from tablemine.operators.lookup import lookup
    rows = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    rows = rows.unionByName(spark.range(2).select((F.col("id") + 900).alias("id"), F.lit(None).cast("long").alias("k")))
    table = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = spark.createDataFrame([(0,)], "k long")
    old, new = lookup(rows, table, "k"), lookup(rows, table, "k", hot=hot)
    assert new.columns == ["id", "k", "v"]
    assert sorted(map(str, old.select("id", "k", "v").collect())) == sorted(map(str, new.collect()))
    assert sorted(map(str, lookup(rows, table, "k", how="inner").select("id", "k", "v").collect())) == sorted(
        map(str, lookup(rows, table, "k", how="inner", hot=hot).collect()))


def test_descriptions_are_made_once_however_often_they_are_read(spark):
    from tablemine.operators.describe import describe_distinct, fill_failed_descriptions
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def model(prompts):
            calls.add(len(prompts))
            return ["<FAILED>" if "Dataset: d1\n" in p else "Dataset Summary: x" for p in prompts]
        return model
    rows = spark.range(60).select(F.concat(F.lit("d"), (F.col("id") % 6).cast("string")).alias("dataset"),
                                  F.lit("xx").alias("subset"), F.lit("").alias("dataset_link"),
                                  F.concat(F.lit("p"), F.col("id").cast("string")).alias("paper_id"))
    texts = rows.select("paper_id", F.lit("text").alias("text"))
    out = fill_failed_descriptions(describe_distinct(rows, factory), texts, lambda: lambda ps: ["again"] * len(ps))
    assert {r.dataset_description for r in out.filter("dataset = 'd1'").collect()} == {"again"}
    assert out.count() == 60 and calls.value == 6


def test_assembly_reads_the_files_once_and_files_without_a_paper_see_no_tree(spark):
    from tablemine.operators.assembly import assemble_papers
    main = "\\begin{document}\n\\input{a}\n\\end{document}\n"
    files = spark.createDataFrame(
        [("p", "main.tex", main), ("p", "a.tex", "body"), ("p", "sec/a.tex", "other"), ("q", "a.tex", "no main"),
         (None, "main.tex", main), (None, "a.tex", "body"), ("r", "main.tex", main), ("r", "a.tex", None)],
        "paper_id string, rel_path string, content string")
    out = assemble_papers(files)
    got = {r.paper_id: r.full_paper_latex_code.strip() for r in out.collect()}
    assert got == {"p": "body", None: "\\input{a}", "r": "\\input{a}"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan


def test_written_tables_are_read_by_column(spark):
    from tablemine.session import written
    rows = spark.range(50).select("id", F.struct(F.col("id").alias("a"), F.repeat(F.lit("x"), 99).alias("b")).alias("r"))
    made = written(rows, "rows")
    assert made.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(str, made.collect())) == sorted(map(str, rows.collect()))
    plan = made.select("r.a")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<r:struct<a:bigint>>" in plan


def test_source_folders_are_rendered_in_one_pass(spark):
    from tablemine.plans.render import customer_paper_files
    rows = [(k, k % 7, "O", "1-URGENT" if k % 5 else None, 9.5) for k in range(40)]
    rows += [(3, 3, "F", "2-HIGH", 1.0), (None, 2, "O", "x", 1.0), (99, None, "O", "x", 1.0)]
    files = customer_paper_files(spark.createDataFrame(rows, ORDERS))
    assert files.columns == ["paper_id", "o_custkey", "chunk", "rel_path", "content"]
    assert "Union" not in files._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.paper_id, r.rel_path) for r in files.collect()]
    want = [(f"c{c}-0", name) for c in range(7) for name in ("main.tex", "notes.tex", *["alt.tex"] * (c % 5 == 0))]
    want += [(f"c{c}-0", f"{'sec/' if k % 6 == 2 else ''}o{k}.tex") for k, c, *_ in rows if None not in (k, c) and k % 6 < 4]
    assert sorted(got) == sorted(want)
    main = {r.paper_id: r.content for r in files.filter("rel_path = 'main.tex'").collect()}
    assert main["c3-0"].split("\n")[6:-3] == [r"\input{other/o3}", r"\input{other/o3}", r"\input{o10.bbl}", r"\input{missing17}",
                                             r"\input{o24}", r"\input{o31.tex}", r"\input{sec/o38}"]
    text = {r.rel_path: r.content for r in files.filter("o_custkey = 0").collect()}
    assert text["o7.tex"] == "Order 7: O 1-URGENT by \\cust{}.\n" and text["o0.tex"] is None
