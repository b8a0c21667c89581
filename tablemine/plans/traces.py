"""The three end-to-end traces, composed from the operators.

A  files            → papers       (assembly, keyword filter, table blocks)
B  papers           → valid records (table relevance, extraction, context,
                                      record flattening, metric rules)
C  valid records    → final table  (citation links, name canonicalisation,
                                      descriptions, dedupe, quality filters)

Each trace is one lazy plan; callers write the three named tables with
``write_dataset`` (which also cuts lineage between traces).  The model
steps take a ``model_factory`` (see ``operators.model``); everything cheap
runs before them so the model sees as few rows as possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RECORD_FIELDS
from ..functions.answers import label_is_true, render_prompt, strip_reasoning, truncate_chars
from ..functions.common import strip_ws
from ..functions.text import clean_context_text, clean_description_text
from ..operators import dedupe as D
from ..operators.assembly import assemble_papers
from ..operators.blocks import extract_table_blocks, papers_with_tables
from ..operators.cells import has_numeric_cell
from ..operators.describe import describe_distinct, fill_failed_descriptions
from ..operators.keywords import keyword_filter
from ..operators.lookup import HOT_ROWS
from ..operators.metrics import invalid_record_stub, standardize_metric
from ..operators.model import ModelFactory, apply_model
from ..operators.names import apply_canonical_names, canonicalize_names
from ..operators.records import extract_records, flatten_records, parse_jsonl_records
from ..session import ensure_checkpoint_dir

TABLE_TEMPLATE = ("Is the following LaTeX table a leaderboard of experiment results? "
                  "Answer true or false.\n{{table}}\n")
EXTRACT_TEMPLATE = ("Extract one JSON object per result from the table below with the keys "
                    + ", ".join(RECORD_FIELDS) + "; use xx when unspecified.\n{{table}}\n")
AUGMENT_TEMPLATE = ("Complete the records using the paper text.\nRecords:\n{{records}}\n"
                    "Table:\n{{table}}\nPaper:\n{{text}}\n")


# ------------------------------------------------------------------ trace A
def papers_from_files(files: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """files (paper_id, rel_path, content) → papers (paper_id, tables
    array<struct<latex,label>>, full_paper_latex_code, keywords)."""
    # the keywords first: blocks are cut out of the papers that stay
    kept = keyword_filter(assemble_papers(files), "full_paper_latex_code", keywords)
    blocks = extract_table_blocks(kept)
    # a generator, so that the blocks are not computed again for a filter
    some = F.explode(F.filter(F.array("tables"), lambda t: F.size(t) > 0)).alias("tables")
    blocks = blocks.select("paper_id", some, "full_paper_latex_code", "keywords")
    return blocks.withColumn("tables", F.transform("tables", lambda t: F.struct(
        t.alias("latex"), F.lit(None).cast("string").alias("label"))))


# ------------------------------------------------------------------ trace B
def relevant_tables(papers: DataFrame, model_factory: ModelFactory | None = None,
                    max_prompt_chars: int | None = None, keywords: list[str] | None = None) -> DataFrame:
    """papers → (paper_id, table_index, table_source).  Rule form: tables
    with at least one numeric cell, and with ``keywords`` those that name one
    of them as well; with a model: its answer contains
    "true" (the model sees the whole table unless ``max_prompt_chars`` is
    given; the original cuts to 10,000 characters)."""
    t = papers_with_tables(papers.withColumn("tables", F.transform("tables", lambda x: x["latex"]))
                           .drop("full_paper_latex_code", "keywords"))
    if keywords is not None:  # the cheaper test first
        t = keyword_filter(t, "table_source", keywords, "_keywords").drop("_keywords")
    if model_factory is None:
        return t.filter(has_numeric_cell("table_source"))
    prompt = render_prompt(TABLE_TEMPLATE, {"table": F.col("table_source")})
    if max_prompt_chars:
        prompt = truncate_chars(prompt, max_prompt_chars)
    answered = apply_model(t.withColumn("_prompt", prompt), "_prompt", model_factory, "_label")
    return answered.filter(label_is_true("_label")).drop("_prompt", "_label")


def extract_table_records(tables: DataFrame, model_factory: ModelFactory) -> DataFrame:
    """tables → + table_results_extracted (reasoning stripped, failures
    dropped)."""
    p = tables.withColumn("_prompt", render_prompt(EXTRACT_TEMPLATE, {"table": F.col("table_source")}))
    a = apply_model(p, "_prompt", model_factory, "_raw").drop("_prompt")
    return extract_records(a, "_raw", "table_results_extracted").drop("_raw")


def augment_records(extracted: DataFrame, paper_text: DataFrame,
                    model_factory: ModelFactory | None = None) -> DataFrame:
    """extracted → one row per record (struct ``record``).  With a model,
    the records, table and cleaned paper text (joined only here, by
    paper_id) go into the context prompt; without one the extracted
    records are used as they are."""
    src = "table_results_extracted"
    if model_factory is not None:
        texts = paper_text.select("paper_id", clean_context_text("full_paper_latex_code").alias("_ctx"))
        p = extracted.join(texts, "paper_id", "left").withColumn(
            "_prompt", render_prompt(AUGMENT_TEMPLATE, {"records": F.col(src),
                                                        "table": F.col("table_source"),
                                                        "text": F.col("_ctx")}))
        a = apply_model(p.drop("_ctx"), "_prompt", model_factory, "_raw").drop("_prompt")
        extracted = a.withColumn("_aug", strip_reasoning("_raw")).drop("_raw")
        src = "_aug"
    recs = flatten_records(parse_jsonl_records(extracted, src))
    return recs.drop("records", "_aug") if "_aug" in recs.columns else recs.drop("records")


def valid_records(records: DataFrame) -> DataFrame:
    """records → + standardized_metric, adjusted_metric_value (rule form of
    the metric prompt; invalid records are rejected)."""
    metric, value = invalid_record_stub(F.col("record.metric"), F.col("record.value"),
                                        F.col("record.pref_tuning_method"))
    r = records.withColumn("_metric", metric).withColumn("_value", value)
    return standardize_metric(r, "_metric", "_value").drop("_metric", "_value")


# ------------------------------------------------------------------ trace C
def final_table(records: DataFrame, describe_model: ModelFactory, source_model: ModelFactory,
                paper_text: DataFrame, links: DataFrame | None = None,
                canonicalize: bool = True) -> DataFrame:
    """valid records → the 13-column final table, under canonical dataset
    names (``canonicalize=False``: the names as extracted)."""
    r = records
    if links is not None:
        r = r.join(links, ["paper_id", "table_index", "record_index"], "left")
    r = (r.withColumn("dataset_link", F.coalesce(F.col("dataset_link"), F.lit("")))
         if "dataset_link" in r.columns else r.withColumn("dataset_link", F.lit("")))
    r = r.withColumn("dataset", F.col("record.dataset")).withColumn("subset", F.col("record.subset"))
    d = describe_distinct(r, describe_model)
    texts = paper_text.select("paper_id", clean_description_text("full_paper_latex_code").alias("text"))
    d = fill_failed_descriptions(d, texts, source_model)
    if canonicalize:
        ensure_checkpoint_dir(r.sparkSession)
        names = r.groupBy(F.col("dataset").alias("name")).count().filter("name is not null").checkpoint()
        hot = names.filter(F.col("count") > HOT_ROWS).select(strip_ws(F.col("name")).alias("name")).distinct()
        d = apply_canonical_names(d, canonicalize_names(names.select("name")), "dataset", "dataset_canonical", hot)
    d = d.withColumn("_o1", F.col("paper_id")).withColumn("_o2", F.col("table_index")) \
         .withColumn("_o3", F.col("record_index"))
    final = D.final_projection(d, name_col="dataset_canonical" if canonicalize else None, extra=["_o1", "_o2", "_o3"])
    deduped = D.dedupe_conflicting(final, order=["_o1", "_o2", "_o3"]).drop("_o1", "_o2", "_o3")
    return D.description_filter(D.sentinel_filter(deduped))
