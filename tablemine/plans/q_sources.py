"""Queries for sources, paper assembly and source-level helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import assembly as S
from .queries import read, register
from .render import customer_paper_files

# Expected per customer folder (one chunk at test scale): orders with
# orderkey % 6 in (0,1,2,3) are inlined, % 6 = 5 stay as \input, bbl vanish.
_ASSEMBLY_ORACLE = """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id,
       CAST(count_if(o_orderkey % 6 IN (0, 1, 2, 3)) AS BIGINT) AS n_inlined,
       CAST(count_if(o_orderkey % 6 = 5) AS BIGINT) AS n_unresolved,
       CAST(coalesce(sum(CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN o_orderkey END), 0) AS BIGINT)
         AS inlined_key_sum,
       CAST(count_if(o_orderkey % 6 IN (0, 1, 2, 3)) AS BIGINT) AS n_macro,
       0 AS n_preamble
FROM orders GROUP BY o_custkey
"""


def _assembly_counts(df: DataFrame, text_col: str, *more: str) -> DataFrame:
    t = F.col(text_col)
    keys = F.regexp_extract_all(t, F.lit(r"Order (\d+): "), 1)
    return df.select(
        "paper_id", *more,
        F.size(keys).cast("bigint").alias("n_inlined"),
        F.regexp_count(t, F.lit(r"\\input\{missing")).cast("bigint").alias("n_unresolved"),
        F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("inlined_key_sum"),
        F.regexp_count(t, F.lit(r"by Customer \d+\.")).cast("bigint").alias("n_macro"),
        F.regexp_count(t, F.lit(r"\\documentclass|\\newcommand")).cast("int").alias("n_preamble"))


@register("assemble_papers", _ASSEMBLY_ORACLE)
def q_assemble_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace A front half: main files → includes → squeeze / percent →
    macros → body → tidy → longest variant."""
    files = customer_paper_files(read(spark, sf_dir, "orders"))
    papers = S.assemble_papers(files.drop("o_custkey", "chunk"))
    return _assembly_counts(papers, "full_paper_latex_code")


@register("resolve_includes", """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id,
       CAST(count_if(o_orderkey % 6 IN (0, 1, 2, 3)) AS BIGINT) AS n_inlined,
       CAST(count_if(o_orderkey % 6 = 5) AS BIGINT) AS n_unresolved,
       CAST(coalesce(sum(CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN o_orderkey END), 0) AS BIGINT)
         AS inlined_key_sum,
       CAST(0 AS BIGINT) AS n_macro,
       2 AS n_preamble, 'main.tex' AS rel_path
FROM orders GROUP BY o_custkey
UNION ALL
SELECT DISTINCT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id, CAST(0 AS BIGINT) AS n_inlined,
       CAST(0 AS BIGINT) AS n_unresolved, CAST(0 AS BIGINT) AS inlined_key_sum, CAST(0 AS BIGINT) AS n_macro,
       0 AS n_preamble, 'alt.tex' AS rel_path
FROM orders WHERE o_custkey % 5 = 0
""")
def q_resolve_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes only, in every main file; macros untouched."""
    files = customer_paper_files(read(spark, sf_dir, "orders")).drop("o_custkey", "chunk")
    return _assembly_counts(S.resolve_includes(S.select_main_files(files), files), "text", "rel_path")


@register("select_main_files", """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id,
       CAST(CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_main_files
FROM orders GROUP BY o_custkey
""")
def q_select_main_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = customer_paper_files(read(spark, sf_dir, "orders")).drop("o_custkey", "chunk")
    return (S.select_main_files(files).groupBy("paper_id")
            .agg(F.count(F.lit(1)).alias("n_main_files")))


@register("expand_macros", """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id,
       CAST(count_if(o_orderkey % 6 IN (0, 1, 2, 3)) AS BIGINT) AS n_macro,
       concat('Customer ', CAST(o_custkey AS VARCHAR)) AS macro_body, 'main.tex' AS rel_path
FROM orders GROUP BY o_custkey
UNION ALL
SELECT DISTINCT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id, CAST(0 AS BIGINT) AS n_macro,
       CAST(NULL AS VARCHAR) AS macro_body, 'alt.tex' AS rel_path
FROM orders WHERE o_custkey % 5 = 0
""")
def q_expand_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = customer_paper_files(read(spark, sf_dir, "orders")).drop("o_custkey", "chunk")
    merged = S.resolve_includes(S.select_main_files(files), files)
    t = S.expand_macros(F.col("text"))
    return merged.select("paper_id", "rel_path",
                         F.regexp_count(t, F.lit(r"by Customer \d+\.")).cast("bigint").alias("n_macro"),
                         F.get(S.usable_macros(F.col("text")), F.lit(0))["body"].alias("macro_body"))


# ------------------------------------------------------- text projections
_BS = "chr(92)"
_TEXT_SAMPLES_SQL = (f"concat('Title', chr(10), chr(10), chr(10), chr(10), chr(10), {_BS}, 'section{{', "
                     f"o_orderpriority, '}}', chr(10), chr(10), 'Total ', CAST(o_orderkey AS STRING), "
                     f"'%  ', chr(10), {_BS}, 'begin{{itemize}}', chr(10), chr(10), {_BS}, 'item ', "
                     f"o_orderstatus, chr(10), chr(10), chr(10), {_BS}, 'end{{itemize}}')")


@register("squeeze_blank_lines", f"""
SELECT o_orderkey, md5(regexp_replace({_TEXT_SAMPLES_SQL.replace('STRING', 'VARCHAR')},
       '\\n{{2,}}', chr(10) || chr(10), 'g')) AS text_md5 FROM orders
""")
def q_squeeze_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TEXT_SAMPLES_SQL).alias("t"))
    return o.select("o_orderkey", F.md5(T.squeeze_blank_lines("t")).alias("text_md5"))


def _duck(sql: str) -> str:
    return sql.replace("STRING", "VARCHAR")


@register("strip_trailing_percent", f"""
SELECT o_orderkey, md5(regexp_replace({_duck(_TEXT_SAMPLES_SQL)}, '%[ \\t\\n\\r\\f\\v]*(\\n|$)', '\\1', 'gm'))
  AS text_md5 FROM orders
""")
def q_strip_trailing_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TEXT_SAMPLES_SQL).alias("t"))
    return o.select("o_orderkey", F.md5(T.strip_trailing_percent("t")).alias("text_md5"))


@register("tidy_block_blanks", f"""
SELECT o_orderkey, md5(regexp_replace(regexp_replace(regexp_replace({_duck(_TEXT_SAMPLES_SQL)},
  '(\\\\[^\\n]*?section[ \\t\\n\\r\\f\\v]*?\\{{[^\\n]*?\\}})\\n{{2,}}', '\\1' || chr(10), 'g'),
  '(\\\\begin[ \\t\\n\\r\\f\\v]*?\\{{[^\\n]*?\\}})\\n{{2,}}', '\\1' || chr(10), 'g'),
  '\\n{{2,}}(\\\\end[ \\t\\n\\r\\f\\v]*?\\{{[^\\n]*?\\}})', chr(10) || '\\1', 'g')) AS text_md5 FROM orders
""")
def q_tidy_block_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TEXT_SAMPLES_SQL).alias("t"))
    return o.select("o_orderkey", F.md5(T.tidy_block_blanks("t")).alias("text_md5"))


@register("document_body", """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id, 'main.tex' AS rel_path, 0 AS n_preamble,
       1 AS n_sections
FROM orders GROUP BY o_custkey
UNION ALL
SELECT DISTINCT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id, 'alt.tex' AS rel_path, 0 AS n_preamble,
       0 AS n_sections
FROM orders WHERE o_custkey % 5 = 0
""")
def q_document_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = customer_paper_files(read(spark, sf_dir, "orders")).drop("o_custkey", "chunk")
    mains = S.select_main_files(files)
    body = T.document_body(F.col("content"))
    return mains.select("paper_id", "rel_path",
                        F.regexp_count(body, F.lit(r"\\documentclass|\\end\{document\}")).cast("int")
                        .alias("n_preamble"),
                        F.regexp_count(body, F.lit(r"\\section\{")).cast("int").alias("n_sections"))


@register("longest_variant", """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id,
       CAST(count_if(o_orderkey % 6 IN (0, 1, 2, 3)) AS BIGINT) AS n_inlined
FROM orders GROUP BY o_custkey
""")
def q_longest_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with a second, shorter main file keep the long one."""
    files = customer_paper_files(read(spark, sf_dir, "orders")).drop("o_custkey", "chunk")
    merged = S.resolve_includes(S.select_main_files(files), files)
    best = S.longest_variant(merged)
    return best.select("paper_id", F.size(F.regexp_extract_all(
        "full_paper_latex_code", F.lit(r"Order (\d+): "), 1)).cast("bigint").alias("n_inlined"))


# ------------------------------------------------------- paths and urls
@register("paper_id_from_path", """
SELECT page_id, trim(regexp_extract(url, '[^/]*$', 0)) AS paper_id FROM pages
""")
def q_paper_id_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", T.paper_id_from_path("url").alias("paper_id"))


_URL_SQL = "CASE WHEN page_id % 3 = 0 THEN concat(url, '/paper.pdf') ELSE url END"


@register("stable_filename", f"""
SELECT page_id, CASE WHEN regexp_extract(u, '[^/]*$', 0) LIKE '%.pdf' THEN regexp_extract(u, '[^/]*$', 0)
                     ELSE concat(substring(md5(u), 1, 10), '.pdf') END AS filename
FROM (SELECT page_id, {_URL_SQL} AS u FROM pages)
""")
def q_stable_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.expr(_URL_SQL).alias("u"))
    return p.select("page_id", A.stable_filename("u").alias("filename"))


_API_SQL = {
    "arxiv": "CASE WHEN page_id % 4 = 0 THEN concat('24', lpad(CAST(page_id % 100 AS STRING), 2, '0'), '.', lpad(CAST(page_id AS STRING), 5, '0')) END",
    "acl": "CASE WHEN page_id % 4 IN (0, 1) THEN concat('2024.acl-long.', CAST(page_id AS STRING)) END",
}


@register("paper_url_derive", """
SELECT page_id, CASE WHEN page_id % 4 = 0
  THEN concat('https://arxiv.org/pdf/24', lpad(CAST(page_id % 100 AS VARCHAR), 2, '0'), '.',
              lpad(CAST(page_id AS VARCHAR), 5, '0'), '.pdf')
  ELSE concat('https://aclanthology.org/2024.acl-long.', CAST(page_id AS VARCHAR), '.pdf') END AS pdf_url
FROM pages WHERE page_id % 4 IN (0, 1)
""")
def q_paper_url_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API rows carry an externalIds map (ArXiv / ACL / nothing)."""
    from ..sources.api import paper_url_derive
    p = read(spark, sf_dir, "pages").select(
        "page_id", *[F.expr(e).alias(k) for k, e in _API_SQL.items()])
    ids = F.map_filter(F.map_from_arrays(F.array(F.lit("ArXiv"), F.lit("ACL")),
                                         F.array("arxiv", "acl")), lambda k, v: v.isNotNull())
    api = p.select("page_id", ids.alias("externalIds"))
    return paper_url_derive(api).select("page_id", "pdf_url")


@register("arxiv_id_parse", """
SELECT page_id, substring(regexp_extract(concat('http://arxiv.org/abs/', CAST(2300 + page_id % 200 AS VARCHAR),
       '.', lpad(CAST(page_id AS VARCHAR), 5, '0'), 'v', CAST(page_id % 3 + 1 AS VARCHAR)), '[^/]*$', 0), 1, 10)
  AS arxiv_id FROM pages
""")
def q_arxiv_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    url = F.concat(F.lit("http://arxiv.org/abs/"), (F.lit(2300) + F.col("page_id") % 200).cast("string"),
                   F.lit("."), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit("v"),
                   (F.col("page_id") % 3 + 1).cast("string"))
    return p.select("page_id", A.arxiv_id_from_url(url).alias("arxiv_id"))


@register("source_path_route", """
SELECT o_orderkey, CASE substring(pid, 1, 2) WHEN '23' THEN 'arxiv_src_2023'
                        WHEN '24' THEN 'arxiv_src_2024' END AS year_folder
FROM (SELECT o_orderkey, concat(CAST(22 + o_orderkey % 4 AS VARCHAR), '01.', CAST(o_orderkey AS VARCHAR)) AS pid
      FROM orders)
""")
def q_source_path_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    pid = F.concat((F.lit(22) + F.col("o_orderkey") % 4).cast("string"), F.lit("01."),
                   F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", A.year_folder(pid).alias("year_folder"))


# ------------------------------------------------------- sources and sinks
@register("shard_split", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 = 2")
def q_shard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.datasets import shard_split
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return shard_split(o, 5, 2, "o_orderkey", by="pmod")


@register("incremental_manifest", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def q_incremental_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose download target is not in the manifest (every third page
    is already done)."""
    from ..sources.datasets import incremental_manifest
    p = read(spark, sf_dir, "pages").select("page_id", A.stable_filename("url").alias("target"))
    done = p.filter(F.col("page_id") % 3 == 0).select("target")
    return incremental_manifest(p, done, ["target"]).select("page_id")


@register("incremental_manifest_stream", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def q_incremental_manifest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a stream with keyed state: the manifest fills the
    state, new pages go to a table in the checkpoint folder."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming.keyed import process_new_items_keyed
    # a pattern, since a stream takes a path for a folder and this may be one file
    pattern = f"{sf_dir.rstrip('/')}/page[s].parquet"
    pages = spark.read.parquet(pattern)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    target = A.stable_filename("url").alias("target")
    done = pages.filter(F.col("page_id") % 3 == 0).select(target)
    stream = spark.readStream.schema(pages.schema).parquet(pattern).select("page_id", target)
    query = process_new_items_keyed(stream, ["target"], lambda new: new.select("page_id"),
                                    f"{base}/pages", f"{base}/state", done)
    query.awaitTermination()
    return spark.read.schema("page_id long").parquet(f"{base}/pages")


@register("json_column_codec", """
SELECT l_orderkey, count(*) AS n_items, true AS round_trip
FROM lineitem GROUP BY l_orderkey
""")
def q_json_column_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tables list ↔ JSON string at the table edge: encode, decode, compare."""
    from ..operators.blocks import extract_table_blocks
    from ..sources.datasets import from_json_column, to_json_column
    from .render import lineitem_papers
    p = extract_table_blocks(lineitem_papers(read(spark, sf_dir, "lineitem")))
    tables = F.transform("tables", lambda t: F.struct(t.alias("latex"), F.lit(None).cast("string").alias("label")))
    enc = p.select("l_orderkey", tables.alias("t"), to_json_column(tables).alias("tables_list"))
    dec = from_json_column("tables_list", "array<struct<latex:string,label:string>>")
    items = F.regexp_count(F.col("t")[0]["latex"], F.lit(r"\n\d+ & \d+ & "))
    return (enc.select("l_orderkey", items.alias("n"), (dec == F.col("t")).alias("ok"))
            .groupBy("l_orderkey").agg(F.sum("n").cast("bigint").alias("n_items"),
                                       F.bool_and("ok").alias("round_trip")))


@register("read_shards", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def q_read_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write orders as shard folders into the session's checkpoint folder
    (shared storage on a cluster) and read them back as one table."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.datasets import read_shards, write_shards
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/shards-{uuid.uuid4().hex}"
    write_shards(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), base, 3, "o_orderkey")
    return read_shards(spark, base).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------- cleaners
from .render import sql_template  # noqa: E402

_CLEAN_SAMPLE = (
    "\\documentclass{article}\n\\usepackage{amsmath}\n\\begin{document}\n\\section{Order {{o_orderkey}}}\n"
    "Total   {{o_custkey}} units, 5\\% off. % note {{o_orderkey}}\n\\begin{figure}\nF\n\\end{figure}\n"
    "\\begin{equation}\nx=1\n\\end{equation}\nSee \\cite{ref{{o_custkey}}} and \\citep{b}.\n"
    "\\begin{table}\nT\n\\end{table}\n\\begin{thebibliography}{9}\nB\n\\end{thebibliography}\n"
    "\\appendix\nA\n\\end{document}\n")


def _clean_chain_sql(duck_text: str, description: bool) -> str:
    t = duck_text
    steps = [(r"(?s)\\appendix.*?\\end\{document\}", ""),
             (r"(?s)\\begin\{figure\}.*?\\end\{figure\}", ""),
             (r"([^\\])%[^\n]*\n", r"\1"),
             (r"\\(usepackage|documentclass|title|author|date|maketitle)[^\n]*?\n", ""),
             (r"\s+", " "),
             (r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}", ""),
             (r"(?s)\\documentclass.*?\\begin\{document\}", r"\\begin{document}"),
             (r"(?s)\\begin\{equation\}.*?\\end\{equation\}", ""),
             (r"(?s)\\begin\{align\}.*?\\end\{align\}", "")]
    if description:
        steps += [(r"\\cite[t|p]?\{[^\n]*?\}", ""), (r"(?s)\\begin\{table\}.*?\\end\{table\}", "")]
    for pat, rep in steps:
        t = f"regexp_replace({t}, '{pat}', '{rep}', 'g')"
    return t


@register("clean_context_text", f"""
SELECT o_orderkey, md5({_clean_chain_sql(sql_template(_CLEAN_SAMPLE, True), False)}) AS text_md5 FROM orders
""")
def q_clean_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(sql_template(_CLEAN_SAMPLE)).alias("t"))
    return o.select("o_orderkey", F.md5(T.clean_context_text("t")).alias("text_md5"))


@register("clean_description_text", f"""
SELECT o_orderkey, md5({_clean_chain_sql(sql_template(_CLEAN_SAMPLE, True), True)}) AS text_md5 FROM orders
""")
def q_clean_description_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(sql_template(_CLEAN_SAMPLE)).alias("t"))
    return o.select("o_orderkey", F.md5(T.clean_description_text("t")).alias("text_md5"))


@register("strip_appendix", f"""
SELECT o_orderkey, md5(regexp_replace({sql_template(_CLEAN_SAMPLE, True)}, '(?s)\\\\appendix.*$', '')) AS text_md5
FROM orders
""")
def q_strip_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(sql_template(_CLEAN_SAMPLE)).alias("t"))
    return o.select("o_orderkey", F.md5(T.strip_appendix("t")).alias("text_md5"))


_LC_SAMPLE = "Row {{o_orderkey}} % note {{o_custkey}}\nKeep 5\\% off % tail\nCut \\\\% here\nplain"
_LC_EXPECTED = "Row {{o_orderkey}} \nKeep 5\\% off % tail\nCut \\\\\nplain"


@register("strip_line_comments", f"""
SELECT o_orderkey, md5({sql_template(_LC_EXPECTED, True)}) AS text_md5 FROM orders
""")
def q_strip_line_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment is cut at its first '%'; a line whose escaped ``\\%``
    comes first is kept whole; ``\\\\%`` (an escaped backslash) does cut."""
    from ..operators.blocks import strip_line_comments
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(sql_template(_LC_SAMPLE)).alias("t"))
    return o.select("o_orderkey", F.md5(strip_line_comments(F.col("t"))).alias("text_md5"))


# ------------------------------------------------------- file tree round trip
def _tree_root(spark: SparkSession) -> str:
    import uuid
    from ..session import ensure_checkpoint_dir
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/tree-{uuid.uuid4().hex}"


#: Files of a rendered source tree that stand on disk at one time, about.
TREE_FILES = 200_000
#: Many small files: some thousands a task, listed by a few tasks.
_SMALL_FILES = {"spark.sql.files.openCostInBytes": "16384", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"}


def _over_tree(spark: SparkSession, sf_dir: str, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``result`` (rows of a paper each) of the customer source folders, written
    as a real file tree (year folder by custkey parity) and scanned.

    A small file takes a whole block of disk, so all folders are rendered once
    into a table dealt by paper; then a part of the papers at a time is written
    as a tree, scanned and taken away, and its result kept."""
    from pyarrow import fs as pafs

    from ..session import text_partitions
    from ..sources.files import scan_paper_tree
    from .render import remove_papers, write_paper_tree
    orders = read(spark, sf_dir, "orders")
    years = ["arxiv_src_2023", "arxiv_src_2024"]
    most = orders.agg(F.count(F.lit(1)) + 3 * F.count_distinct("o_custkey")).first()[0]
    parts = -(-most // TREE_FILES) or 1
    files = customer_paper_files(orders).withColumn("year", F.when(F.col("o_custkey") % 2 == 0, years[0]).otherwise(years[1]))
    files = files.select("year", "paper_id", "rel_path", "content", F.pmod(F.xxhash64("paper_id"), F.lit(parts)).cast("int").alias("part"))
    root = _tree_root(spark)
    spread = F.pmod(F.hash("paper_id"), F.lit(spark.sparkContext.defaultParallelism))
    files.repartition(text_partitions(spark), "part", spread).write.partitionBy("part").parquet(f"{root}-files")
    rendered = spark.read.schema(files.schema).parquet(f"{root}-files")
    before = {k: spark.conf.get(k) for k in _SMALL_FILES}
    try:
        for k, v in _SMALL_FILES.items():
            spark.conf.set(k, v)
        for part in range(parts):
            tree, here = f"{root}/{part}", rendered.filter(F.col("part") == part)
            filesystem, base = pafs.FileSystem.from_uri(tree)
            for year in years:
                filesystem.create_dir(f"{base}/{year}", recursive=True)
            write_paper_tree(here, tree).write.format("noop").mode("overwrite").save()
            result(scan_paper_tree(spark, tree, years)).write.mode("append").parquet(f"{root}-result")
            remove_papers(here.filter(F.col("rel_path") == "main.tex"), tree).write.format("noop").mode("overwrite").save()
            filesystem.delete_dir(base)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.parquet(f"{root}-result")


@register("scan_paper_tree", """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id,
       CASE WHEN o_custkey % 2 = 0 THEN 'arxiv_src_2023' ELSE 'arxiv_src_2024' END AS year,
       CAST(count_if(o_orderkey % 6 IN (0, 1, 2, 3)) + 2 + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END
            AS BIGINT) AS n_files,
       CAST(count_if(o_orderkey % 6 = 2) AS BIGINT) AS n_nested
FROM orders GROUP BY o_custkey
""")
def q_scan_paper_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source folders written as files, read back with the binaryFile source."""
    return _over_tree(spark, sf_dir, lambda files: files.groupBy("paper_id", "year").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.contains("rel_path", F.lit("/"))).alias("n_nested")))


@register("read_archives", """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id,
       CAST(CASE WHEN o_custkey % 10 = 7 THEN 0
            ELSE count_if(o_orderkey % 6 IN (0, 1, 2, 3)) + 2 + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS n_files,
       CAST(CASE WHEN o_custkey % 10 = 7 THEN 0 ELSE count_if(o_orderkey % 6 = 2) END AS BIGINT) AS n_nested,
       CAST(CASE WHEN o_custkey % 10 = 7 THEN 1 ELSE 0 END AS BIGINT) AS n_errors
FROM orders GROUP BY o_custkey
""")
def q_read_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source folders written as archives (every tenth cut short), streamed
    back by the archive source."""
    from ..sources.archives import read_archives
    from .render import write_archives
    root = _tree_root(spark)
    write_archives(customer_paper_files(read(spark, sf_dir, "orders")), root).write.format("noop").mode("overwrite").save()
    rows = read_archives(spark, root)
    good = F.col("error").isNull()
    return rows.groupBy("paper_id").agg(
        F.count_if(good).alias("n_files"), F.count_if(good & F.contains("rel_path", F.lit("/"))).alias("n_nested"),
        F.count_if(~good).alias("n_errors"))


@register("list_top_level_tex", """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id,
       CAST(count_if(o_orderkey % 6 IN (0, 1, 3)) + 2 + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END
            AS BIGINT) AS n_top_tex
FROM orders GROUP BY o_custkey
""")
def q_list_top_level_tex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import list_top_level_tex
    return _over_tree(spark, sf_dir, lambda files: list_top_level_tex(files).groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("n_top_tex")))


@register("write_dataset", "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum "
                           "FROM orders GROUP BY o_orderpriority")
def q_write_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage table saved (partitioned by priority) into shared storage and
    read back."""
    from ..sources.datasets import read_dataset, write_dataset
    path = _tree_root(spark) + "-table"
    write_dataset(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), path,
                  partition_by=["o_orderpriority"])
    return read_dataset(spark, path).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("bigint").alias("key_sum"))


@register("read_dataset", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders")
def q_read_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.datasets import read_dataset, write_dataset
    path = _tree_root(spark) + "-table"
    write_dataset(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path)
    d = read_dataset(spark, path)
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers"))


@register("concat_shards", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def q_concat_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.datasets import concat_shards, shard_split
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    # three tables on purpose: the operator puts separately made shards together
    parts = [shard_split(o, 3, i, "o_orderkey") for i in range(3)]
    return concat_shards(*parts).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("extract_macros", """
SELECT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id, 1 AS n_macros,
       concat(chr(92), 'cust') AS macro_name, concat('Customer ', CAST(o_custkey AS VARCHAR)) AS macro_body,
       0 AS n_args, 'main.tex' AS rel_path
FROM orders GROUP BY o_custkey
UNION ALL
SELECT DISTINCT concat('c', CAST(o_custkey AS VARCHAR), '-0') AS paper_id, 0 AS n_macros,
       CAST(NULL AS VARCHAR) AS macro_name, CAST(NULL AS VARCHAR) AS macro_body, CAST(NULL AS INTEGER) AS n_args,
       'alt.tex' AS rel_path
FROM orders WHERE o_custkey % 5 = 0
""")
def q_extract_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = customer_paper_files(read(spark, sf_dir, "orders")).drop("o_custkey", "chunk")
    mains = S.select_main_files(files)
    m = S.extract_macros(F.col("content"))
    first = F.get(m, F.lit(0))
    return mains.select("paper_id", "rel_path", F.size(m).alias("n_macros"), first["name"].alias("macro_name"),
                        first["content"].alias("macro_body"), first["nargs"].alias("n_args"))
