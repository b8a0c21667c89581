"""Round-trip fixtures: render LaTeX / JSON / BibTeX text out of the driver
tables inside Spark, so every text operator has an exact expected answer
that is plain SQL on the source table.

Groups (an order's line items, a supplier's parts) are turned into one
document each.  A group may be huge (one key can hold a large share of all
rows), so groups are cut into bounded chunks first: the per-key row count
comes from a partially-aggregated ``groupBy``, each row gets
``chunk = pmod(xxhash64(row key), ceil(n / max_rows))`` and the data is
hash-partitioned on (key, chunk) before ``collect_list``.  No document
ever holds more than about ``max_rows`` rows and a hot key spreads over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import text_partitions

MAX_TABLE_ROWS = 256
NOISE_KINDS = 8


def bounded_chunks(df: DataFrame, key: str, row_key: list[str],
                   max_rows: int = MAX_TABLE_ROWS) -> DataFrame:
    """Add ``chunk`` so that each (key, chunk) holds about max_rows rows; the
    rows of a (key, chunk) stand in one partition."""
    return chunked(df, key, row_key, max_rows).repartition(text_partitions(df.sparkSession), key, "chunk")


def chunked(df: DataFrame, key: str, row_key: list[str], max_rows: int) -> DataFrame:
    # only large groups need their count: a small table to join with
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_group_rows")).filter(F.col("_group_rows") > max_rows)
    n_chunks = F.ceil(F.coalesce("_group_rows", F.lit(1)) / F.lit(float(max_rows))).cast("long")
    return (df.filter(F.col(key).isNotNull()).join(counts, key, "left")
            .withColumn("chunk", F.pmod(F.xxhash64(*row_key), n_chunks).cast("int"))
            .drop("_group_rows"))


def _ordered_join(rows_col: str, field: str, sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.sort_array(rows_col), lambda r: r[field]), sep)


def lineitem_papers(lineitem: DataFrame, noise: bool = True,
                    max_rows: int = MAX_TABLE_ROWS) -> DataFrame:
    """RT-TABLE / RT-NOISE: one paper per (order, chunk) holding one table.

    Cells per line item: part key, line number, quantity (decimal(12,2)) in
    ``\\textbf``.  With ``noise`` the table is varied by ``pmod(orderkey, 8)``:
    1 trailing comments, 2 ``$q \\pm 0.1$``, 3 ``\\multirow``, 4 a tabular
    nested in the header, 5 a ``figure`` around the ``table``, 6 a caption
    brace closed only after the table, 7 an extra ``total & 1,234 & 7b`` row.
    Output: l_orderkey, chunk, paper_id, full_paper_latex_code.
    """
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_quantity").cast("decimal(12,2)").cast("string").alias("qty"))
    li = chunked(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], max_rows)
    key_txt = F.concat(F.col("l_orderkey").cast("string"), F.lit("c"), F.col("chunk").cast("string"))
    # dealt by paper, so that a join by paper need not move the texts again
    li = (li.withColumn("paper_id", F.concat(F.lit("o"), key_txt))
          .repartition(text_partitions(lineitem.sparkSession), "paper_id"))
    kind = F.pmod(F.col("l_orderkey"), F.lit(NOISE_KINDS)) if noise else F.lit(0)
    li = li.withColumn("kind", kind)
    q = F.col("qty")
    qty_cell = (F.when(F.col("kind") == 2, F.concat(F.lit("$"), q, F.lit(" \\pm 0.1$")))
                 .when(F.col("kind") == 3, F.concat(F.lit("\\multirow{1}{*}{"), q, F.lit("}")))
                 .otherwise(F.concat(F.lit("\\textbf{"), q, F.lit("}"))))
    line = F.concat(F.col("l_partkey").cast("string"), F.lit(" & "),
                    F.col("l_linenumber").cast("string"), F.lit(" & "), qty_cell, F.lit(" \\\\"),
                    F.when(F.col("kind") == 1, F.concat(F.lit(" % line "),
                                                        F.col("l_linenumber").cast("string")))
                     .otherwise(F.lit("")))
    grouped = (li.groupBy("paper_id", "l_orderkey", "chunk", "kind")
               .agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey",
                                            line.alias("line"))).alias("rows")))
    k = F.col("kind")
    header = F.when(k == 4, F.lit("\\begin{tabular}{c}part\\\\id\\end{tabular} & line & qty \\\\")) \
              .otherwise(F.lit("part & line & qty \\\\"))
    total = F.when((k == 7) & (F.col("chunk") == 0), F.lit("\ntotal & 1,234 & 7b \\\\")).otherwise(F.lit(""))
    caption = F.concat(F.lit("\\caption{Order "), F.col("l_orderkey").cast("string"),
                       F.when(k == 6, F.lit("")).otherwise(F.lit("}")))
    table = F.concat(
        F.lit("\\begin{table}[t]\n\\centering\n"), caption, F.lit("\n\\label{tab:"), key_txt,
        F.lit("}\n\\begin{tabular}{rrr}\n\\toprule\n"), header, F.lit("\n\\midrule\n"),
        _ordered_join("rows", "line"), total, F.lit("\n\\bottomrule\n\\end{tabular}\n\\end{table}"))
    table = F.when(k == 5, F.concat(F.lit("\\begin{figure}[h]\n"), table, F.lit("\n\\end{figure}"))) \
             .otherwise(table)
    after = F.when(k == 6, F.lit("\nSee the notes.}")).otherwise(F.lit(""))
    paper = F.concat(
        F.lit("\\documentclass{article}\n\\usepackage{booktabs}\n\\begin{document}\n"
              "\\section{Results}\nTable~\\ref{tab:"), key_txt, F.lit("} lists the order.\n\n"),
        table, after, F.lit("\n\n\\end{document}\n"))
    return grouped.select("l_orderkey", "chunk", "paper_id",
                          paper.alias("full_paper_latex_code"))


def customer_paper_files(orders: DataFrame, max_rows: int = MAX_TABLE_ROWS) -> DataFrame:
    """RT-FILES / RT-MACRO: a source folder per (customer, chunk).

    Files: ``main.tex`` (preamble with ``\\newcommand{\\cust}{Customer <c>}``,
    one ``\\input`` per order), one file per order, ``notes.tex`` without a
    document, and for custkey % 5 = 0 a shorter second main file
    ``alt.tex``.  By orderkey % 6 the input target is: 0 ``o<k>``, 1
    ``o<k>.tex``, 2 ``sec/o<k>`` (file in a sub-folder), 3 ``other/o<k>``
    (only the base name exists), 4 ``o<k>.bbl`` (removed), 5 ``missing<k>``
    (no file, command stays).  Output: paper_id, o_custkey, chunk,
    rel_path, content.
    """
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    o = bounded_chunks(o, "o_custkey", ["o_orderkey"], max_rows)
    k = F.col("o_orderkey").cast("string")
    m = F.col("o_orderkey") % 6
    target = (F.when(m == 0, F.concat(F.lit("o"), k)).when(m == 1, F.concat(F.lit("o"), k, F.lit(".tex")))
               .when(m == 2, F.concat(F.lit("sec/o"), k)).when(m == 3, F.concat(F.lit("other/o"), k))
               .when(m == 4, F.concat(F.lit("o"), k, F.lit(".bbl")))
               .otherwise(F.concat(F.lit("missing"), k)))
    file_path = F.when(m == 2, F.concat(F.lit("sec/o"), k, F.lit(".tex"))).when(
        m.isin(0, 1, 3), F.concat(F.lit("o"), k, F.lit(".tex")))
    paper_id = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("-"),
                        F.col("chunk").cast("string"))
    o = o.withColumn("paper_id", paper_id)
    content = F.concat(F.lit("Order "), k, F.lit(": "), F.col("o_orderstatus"), F.lit(" "),
                       F.col("o_orderpriority"), F.lit(" by \\cust{}.\n"))
    # a folder is one row, and its files come out of that row: the orders are dealt once
    folders = (o.groupBy("paper_id", "o_custkey", "chunk")
               .agg(F.collect_list(F.struct("o_orderkey", target.alias("t"), file_path.alias("rel_path"),
                                            content.alias("content"))).alias("inc")))
    cust = F.col("o_custkey").cast("string")
    targets = F.array_sort(F.transform("inc", lambda r: F.struct(r["o_orderkey"].alias("o_orderkey"), r["t"].alias("t"))))
    main_text = F.concat(
        F.lit("\\documentclass{article}\n\\newcommand{\\cust}{Customer "), cust,
        F.lit("}\n\\begin{document}\n\\section{Orders}\n\n\n"),
        F.array_join(F.transform(targets, lambda r: F.concat(F.lit("\\input{"), r["t"], F.lit("}"))), "\n"),
        F.lit("\n\n\\end{document}\n"))

    def file(name: str, text: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("rel_path"), text.alias("content")))
    order_files = F.transform(F.filter("inc", lambda r: r["rel_path"].isNotNull()), lambda r: F.struct(
        r["rel_path"].alias("rel_path"), r["content"].alias("content")))
    alt = file("alt.tex", F.lit("\\begin{document}\nshort\n\\end{document}\n"))
    files = F.concat(file("main.tex", main_text), order_files, file("notes.tex", F.lit("% notes, no document here\n")),
                     F.when(F.col("o_custkey") % 5 == 0, alt).otherwise(F.slice(alt, 1, 0)))
    return folders.select("paper_id", "o_custkey", "chunk", F.inline(files))


def sql_template(template: str, duck: bool = False) -> str:
    """A LaTeX template as one SQL ``concat`` expression that Spark SQL and
    DuckDB evaluate to the same text: backslashes and newlines become
    ``chr(92)`` / ``chr(10)`` (Spark SQL literals would eat the backslash),
    and ``{{col}}`` inserts a column or SQL expression cast to text."""
    import re as _re
    cast_to = "VARCHAR" if duck else "STRING"
    parts: list[str] = []
    for piece in _re.split(r"(\{\{.*?\}\})", template):
        if piece.startswith("{{") and piece.endswith("}}"):
            parts.append(f"CAST(({piece[2:-2]}) AS {cast_to})")
            continue
        buf = ""
        for ch in piece:
            if ch in "\\\n'":
                if buf:
                    parts.append("'" + buf + "'")
                    buf = ""
                parts.append({"\\": "chr(92)", "\n": "chr(10)", "'": "chr(39)"}[ch])
            else:
                buf += ch
        if buf:
            parts.append("'" + buf + "'")
    return "concat(" + ", ".join(parts) + ")" if parts else "''"


def write_archives(files: DataFrame, root: str) -> DataFrame:
    """Write a files table (paper_id, rel_path, content) as one
    ``<root>/<paper_id>.tar.gz`` a paper, a fixture for the archive source (a
    retried task writes an archive again, with the same content).  A paper's
    name ending in ``7-0`` gives an archive cut short after its first half."""
    def write(batches):
        import io
        import itertools
        import tarfile

        import pandas as pd
        from pyarrow import fs as pafs
        filesystem, base = pafs.FileSystem.from_uri(root)
        filesystem.create_dir(base, recursive=True)
        rows = (row for pdf in batches for row in zip(pdf["paper_id"], pdf["rel_path"], pdf["content"]))
        out = []
        for paper, members in itertools.groupby(rows, lambda row: row[0]):
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
                for _, name, content in members:
                    data = (content or "").encode("utf-8")
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            data = buffer.getvalue()
            if paper.endswith("7-0"):
                data = data[:20]
            with filesystem.open_output_stream(f"{base.rstrip('/')}/{paper}.tar.gz", compression=None) as fh:
                fh.write(data)
            out.append((paper, len(data)))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=["paper_id", "bytes"])
                out = []
        yield pd.DataFrame(out, columns=["paper_id", "bytes"]).astype({"paper_id": object, "bytes": "int64"})

    # the rows of a paper stand together, so a task writes one archive after the other
    rows = files.select("paper_id", "rel_path", "content").repartition(text_partitions(files.sparkSession), "paper_id")
    return rows.sortWithinPartitions("paper_id", "rel_path", "content").mapInPandas(write, "paper_id string, bytes long")


def write_paper_tree(files: DataFrame, root: str, year_col: str = "year") -> DataFrame:
    """Write a files table (year, paper_id, rel_path, content) out as a
    source tree ``<root>/<year>/<paper_id>/<rel_path>``, as a fixture for the scan (a
    retried task writes a file again, with the same content).  Each task writes
    its own files through ``pyarrow.fs`` (local, HDFS, S3, … by URI), so the
    tree is produced in parallel; returns (path, bytes) per file."""
    schema = "path string, bytes long"

    def write(batches):
        import pandas as pd
        from pyarrow import fs as pafs
        filesystem, base = pafs.FileSystem.from_uri(root)
        made = set()
        for pdf in batches:
            out = []
            for y, p, r, c in zip(pdf[year_col], pdf["paper_id"], pdf["rel_path"], pdf["content"]):
                path = f"{base.rstrip('/')}/{y}/{p}/{r}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                data = (c or "").encode("utf-8")
                with filesystem.open_output_stream(path) as fh:
                    fh.write(data)
                out.append((path, len(data)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return files.select(year_col, "paper_id", "rel_path", "content").mapInPandas(write, schema)


def remove_papers(papers: DataFrame, root: str, year_col: str = "year") -> DataFrame:
    """Take the folders of ``papers`` (year, paper_id; one row each) out of a
    tree that ``write_paper_tree`` wrote; returns (path) per folder."""
    def remove(batches):
        import pandas as pd
        from pyarrow import fs as pafs
        filesystem, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            paths = [f"{base.rstrip('/')}/{y}/{p}" for y, p in zip(pdf[year_col], pdf["paper_id"])]
            for path in paths:
                # a retried task finds some folders gone
                if filesystem.get_file_info(path).type != pafs.FileType.NotFound:
                    filesystem.delete_dir(path)
            yield pd.DataFrame({"path": paths})

    return papers.select(year_col, "paper_id").mapInPandas(remove, "path string")
