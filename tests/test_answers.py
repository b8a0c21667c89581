"""Answer parsing, metric rules, post-processing filters and dedupe."""

from pyspark.sql import functions as F

from tablemine.functions.answers import (arxiv_id_from_url, jsonl_records, stable_filename,
                                         strip_reasoning, year_folder)
from tablemine.operators.dedupe import dedupe_conflicting, sentinel_filter
from tablemine.operators.metrics import parse_metric_answer, standardize_metric
from conftest import one_col


def test_strip_reasoning(spark):
    df = one_col(spark, ["<think>a", "<think>a</think> b ", "b", "<think>x</think>y</think>z"])
    got = [r.v for r in df.select(strip_reasoning("c").alias("v")).collect()]
    assert got == ["<FAILED>", "b", "b", "y</think>z"]


def test_metric_prompt_examples(spark):
    df = spark.createDataFrame([("Sentiment Analysis Accuracy", "0.6"), ("d-BLEU", "0.45"),
                                ("Fleuncy", "71"), ("F1-score", "60%"), ("MRR", "0.5")],
                               "metric string, value string")
    got = {r.metric: (r.standardized_metric, r.adjusted_metric_value)
           for r in standardize_metric(df).collect()}
    assert got["Sentiment Analysis Accuracy"] == ("Accuracy", 60.0)
    assert got["d-BLEU"] == ("BLEU", 45.0)
    assert "Fleuncy" not in got
    assert got["F1-score"] == ("F1", 60.0)
    assert got["MRR"] == ("MRR", 0.5)


def test_metric_answer_forms(spark):
    answers = ['{"Metric_Name": "Accuracy", "Metric_Value": 60}',
               "{'Metric_Name': 'BLEU', 'Metric_Value': 45.5}",
               '```json\n{"Metric_Name": "F1",\n "Metric_Value": 7}\n```',
               "<FAILED>", '{"Metric_Name": "F1", "Metric_Value": "n/a"}']
    df = one_col(spark, answers, "answer")
    got = sorted((r.standardized_metric, r.adjusted_metric_value)
                 for r in parse_metric_answer(df).collect())
    assert got == [("Accuracy", 60.0), ("BLEU", 45.5), ("F1", 7.0)]


def test_jsonl_records_skip_bad_lines(spark):
    text = '{"value": "1", "metric": "Acc"}\nnot json\n[1, 2]\n{"value": 2}\n{"value": "3"'
    df = one_col(spark, [text])
    recs = df.select(jsonl_records("c").alias("r")).collect()[0].r
    assert [r.value for r in recs] == ["1", "2"]


def test_dedupe_conflicting(spark):
    df = spark.createDataFrame([("k", 1.0, 1), ("k", 1.0, 2), ("m", 1.0, 1), ("m", 2.0, 2),
                                ("j", 5.0, 1)], "dataset_name string, v double, o int")
    got = sorted((r.dataset_name, r.o) for r in
                 dedupe_conflicting(df, ["dataset_name"], "v", ["o"]).collect())
    assert got == [("j", 1), ("k", 1)]


def test_dedupe_is_order_insensitive(spark):
    rows = [(f"k{i % 7}", float(i % 3 == 0), i) for i in range(200)]
    df = spark.createDataFrame(rows, "dataset_name string, v double, o int")
    a = sorted(dedupe_conflicting(df, ["dataset_name"], "v", ["o"]).collect())
    b = sorted(dedupe_conflicting(df.repartition(13).orderBy(F.rand(7)), ["dataset_name"], "v",
                                  ["o"]).collect())
    assert a == b


def test_sentinel_filter(spark):
    rows = [("d", "xx", "Acc", "DPO"), ("d", None, "Acc", "DPO"), ("d", "", "Acc", "DPO"),
            ("d", "m", "xx", "DPO"), ("d", "m", None, "DPO"), ("xx", "m", "Acc", "DPO"),
            ("d", "m", "Acc", "<FAILED>"), ("d", "m", "Acc", "DPO")]
    df = spark.createDataFrame(rows, "dataset_name string, model_name string, metric string, "
                                     "pref_tuning_method string")
    kept = sentinel_filter(df).collect()
    assert sorted((r.model_name or "") for r in kept) == ["", "m", "xx"]


def test_small_helpers(spark):
    df = one_col(spark, ["https://h/a.pdf", "https://h/x?y"])
    got = [r.v for r in df.select(stable_filename("c").alias("v")).collect()]
    assert got[0] == "a.pdf" and len(got[1]) == 14 and got[1].endswith(".pdf")
    df = one_col(spark, ["http://h/abs/2301.12345v2"])
    assert df.select(arxiv_id_from_url("c")).collect()[0][0] == "2301.12345"
    df = one_col(spark, ["2305.1", "2401.2", "1907.3"])
    assert [r[0] for r in df.select(year_folder("c")).collect()] == [
        "arxiv_src_2023", "arxiv_src_2024", None]


def test_metric_out_of_range_flag(spark):
    df = spark.createDataFrame([("Accuracy", "150"), ("MRR", "2"), ("Correlation", "-0.5"),
                                ("MSE", "-1"), ("Recall", "0.5")], "metric string, value string")
    got = {r.metric: (r.adjusted_metric_value, r.out_of_range) for r in standardize_metric(df).collect()}
    assert got == {"Accuracy": (150.0, True), "MRR": (2.0, True), "Correlation": (-0.5, False),
                   "MSE": (-1.0, True), "Recall": (50.0, False)}
