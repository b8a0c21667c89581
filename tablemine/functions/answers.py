"""Scalar functions over model answers, prompts and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FAILED, RECORD_FIELDS
from .common import col, count_sub, strip_ws

# Python str.splitlines() boundaries
LINE_BREAKS = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def strip_reasoning(answer) -> Column:
    """Text after the first ``</think>``, trimmed; exactly one ``<think>``
    and no ``</think>`` (budget ran out mid-thought) → ``<FAILED>``; no tag
    → the whole text, trimmed."""
    a = col(answer)
    after = F.element_at(F.split(a, "</think>", 2), -1)
    return (F.when((count_sub(a, "<think>") == 1) & (count_sub(a, "</think>") == 0), F.lit(FAILED))
             .otherwise(strip_ws(after)))


def jsonl_records(answer) -> Column:
    """array<struct of the 11 record fields>: each line parsed as a JSON
    object of string values; lines that are not objects are skipped."""
    lines = F.split(strip_ws(col(answer)), LINE_BREAKS)
    maps = F.transform(lines, lambda l: F.from_json(l, "map<string,string>"))
    good = F.filter(maps, lambda m: m.isNotNull())
    return F.transform(good, lambda m: F.struct(*[m[f].alias(f) for f in RECORD_FIELDS]))


def metric_answer_fields(answer) -> Column:
    """struct<name, value double> from a metric answer, or NULL.

    Newlines and code fences are removed, single quotes become double
    quotes, the JSON object is parsed and its value must read as a float.
    """
    t = col(answer)
    for s in ["\n", "```json", "```"]:
        t = F.replace(t, F.lit(s), F.lit(""))
    m = F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "map<string,string>")
    v = strip_ws(m["Metric_Value"])
    num = F.when(v.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"),
                 v.try_cast("double"))
    return F.when(~F.contains(t, F.lit(FAILED)) & m.isNotNull() & num.isNotNull(),
                  F.struct(m["Metric_Name"].alias("name"), num.alias("value")))


def yes_no_unclear(answer) -> Column:
    """struct<label, justification>: a leading Yes / No / Unclear."""
    a = col(answer)
    rx = r"(?is)^\W*(yes|no|unclear)\b(.*)$"
    label = F.regexp_extract(a, rx, 1)
    return F.struct(F.when(label != "", F.initcap(label)).alias("label"),
                    F.when(label != "", strip_ws(F.regexp_extract(a, rx, 2))).alias("justification"))


def label_is_true(answer) -> Column:
    return F.contains(F.lower(col(answer)), F.lit("true"))


def render_prompt(template: str, slots: dict[str, Column | str]) -> Column:
    """Literal ``{{slot}}`` replacement; every slot must occur in the template."""
    out = F.lit(template)
    for name, value in slots.items():
        token = "{{" + name + "}}"
        if token not in template:
            raise ValueError(f"template has no slot {token}")
        out = F.replace(out, F.lit(token), F.coalesce(col(value), F.lit("")))
    return out


def chat_wrap(prompt, role: str = "user") -> Column:
    """One-message chat: array<struct<role, content>>."""
    return F.array(F.struct(F.lit(role).alias("role"), col(prompt).alias("content")))


def plain_chat(prompt) -> Column:
    return F.concat(F.lit("User: "), col(prompt), F.lit("\nAssistant:"))


def truncate_chars(text, n: int) -> Column:
    return F.substr(col(text), F.lit(1), F.lit(n))


def arxiv_id_from_url(url) -> Column:
    """Last path segment, first 10 characters (drops the version)."""
    return F.substr(F.substring_index(col(url), "/", -1), F.lit(1), F.lit(10))


def stable_filename(url) -> Column:
    """URL basename when it ends in .pdf, else first 10 hex of md5 + .pdf."""
    u = col(url)
    base = F.substring_index(u, "/", -1)
    return F.when(F.endswith(base, F.lit(".pdf")), base).otherwise(
        F.concat(F.substr(F.md5(u), F.lit(1), F.lit(10)), F.lit(".pdf")))


def year_folder(paper_id) -> Column:
    """Source-tree year folder from the id's first two digits, else NULL."""
    from ..constants import YEAR_FOLDERS
    p = F.substr(col(paper_id), F.lit(1), F.lit(2))
    out = None
    for prefix, folder in YEAR_FOLDERS:
        out = F.when(p == prefix, F.lit(folder)) if out is None else out.when(p == prefix, F.lit(folder))
    return out
