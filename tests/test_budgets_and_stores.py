"""Token budgets, the answer store, observed counts, global order, rule tables."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import one_col
from tablemine.operators.metrics import METRIC_RULES, rule_candidates, rule_table, standardize_metric, standardize_metric_by_rules
from tablemine.operators.ordering import sorted_inputs
from tablemine.operators.prompts import truncate_prompt_tokens
from tablemine.operators.records import drop_failed_counted


# ------------------------------------------------------------ token budget
def test_uncut_texts_stay_byte_for_byte(spark):
    texts = [None, "", "   ", " one\ttwo \n", "one two three", " one  two still\n three four ", "日本 語 テキスト x y", "w " * 5000]
    got = [r.p for r in one_col(spark, texts).select(truncate_prompt_tokens("c", 3).alias("p")).collect()]
    assert got == [None, "", "   ", " one\ttwo \n", "one two three", " one  two still\n three", "日本 語 テキスト", "w w w"]
    assert [r.p for r in one_col(spark, ["a b", None]).select(truncate_prompt_tokens("c", 0).alias("p")).collect()] == ["", None]
    with pytest.raises(ValueError):
        truncate_prompt_tokens("c", -1)


def test_user_tokenizer_with_offsets(spark):
    def pairs():
        # two characters a token, called in batches of two texts
        def offsets(texts):
            assert len(texts) <= 2
            return [[(k, min(k + 2, len(t))) for k in range(0, len(t), 2)] for t in texts]
        return offsets
    got = [r.p for r in one_col(spark, ["abcdefg", "abcd", "abc", "é" * 9]).coalesce(1)
           .select(truncate_prompt_tokens("c", 2, pairs, per_call=2).alias("p")).collect()]
    assert sorted(got) == sorted(["abcd", "abcd", "abc", "éééé"])


# ------------------------------------------------------------ answer store
def test_each_prompt_is_asked_once_over_two_runs(spark):
    from tablemine.operators.answers_store import apply_model_once, stored_answers
    base = tempfile.mkdtemp(prefix="tablemine-store-")
    log, store = os.path.join(base, "asked"), os.path.join(base, "store")
    os.mkdir(log)

    def counting():
        import uuid

        def model(prompts):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write("".join(p + "\n" for p in prompts))
            return [p.upper() for p in prompts]
        return model

    def asked():
        return sorted(x for n in os.listdir(log) for x in open(os.path.join(log, n)).read().split("\n")[:-1])

    first = spark.createDataFrame([(k, f"p{k % 7}") for k in range(50)] + [(99, None)], "id long, prompt string")
    got = {r.id: r.answer for r in apply_model_once(first, "prompt", counting, store, batches=3).collect()}
    assert got == {**{k: f"P{k % 7}" for k in range(50)}, 99: ""}
    assert asked() == sorted([f"p{k}" for k in range(7)] + [""])
    more = spark.createDataFrame([(k, f"p{k % 10}") for k in range(30)], "id long, prompt string")
    got = {r.id: r.answer for r in apply_model_once(more, "prompt", counting, store).collect()}
    assert got == {k: f"P{k % 10}" for k in range(30)}
    assert asked() == sorted([f"p{k}" for k in range(10)] + [""])
    assert stored_answers(spark, store).count() == 11
    assert apply_model_once(more.limit(0), "prompt", counting, store).count() == 0


# ------------------------------------------------------------ observed counts
def test_counts_come_from_the_filtering_pass(spark):
    df = one_col(spark, ["a", "<FAILED>", None, "x <FAILED> y", ""], "ans")
    kept, counted = drop_failed_counted(df, "ans")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "CollectMetrics" in plan
    assert sorted(r.ans for r in kept.collect()) == ["", "a"]
    assert counted.get == {"n_total": 5, "n_failed": 2}


# ------------------------------------------------------------ global order
def test_ranks_are_gapless_over_many_ranges(spark):
    r = random.Random(3)
    rows = [(f"dir{r.randint(0, 40)}/f{r.randint(0, 99)}.tex", k) for k in range(3000)] + [(None, -1), ("", -2), ("é", -3)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "path string, k long").repartition(6)
        out = sorted_inputs(df, ["path", "k"])
        assert [tuple(x) for x in out.orderBy("rank").collect()] == [
            (*x, i) for i, x in enumerate(sorted(rows, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1])))]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan.split("BroadcastExchange")[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted_inputs(df.limit(0), ["path"]).count() == 0
    # ties: any order among them, but no gap
    ties = sorted_inputs(df.select(F.lit("same").alias("path"), "k"), ["path"])
    assert sorted(x["rank"] for x in ties.collect()) == list(range(len(rows)))


# ------------------------------------------------------------ rule table
def test_rule_table_equals_the_fixed_rules(spark):
    names = ["Sentiment Analysis Accuracy", "d-BLEU", "F1-score", "Fleuncy", "Win Rate (%)", "win-rate", "EM", "them", "F score",
             "Score", "Acc.", "macc", "Mean  Squared Error", "mean squared error", "Rouge-L", "", None, "f1 precision"]
    rows = [(i, n, v) for i, (n, v) in enumerate((n, v) for n in names for v in ("0.6", "60%", "none"))]
    df = spark.createDataFrame(rows, "id long, metric string, value string")
    want = {tuple(r) for r in standardize_metric(df).collect()}
    assert {tuple(r) for r in standardize_metric_by_rules(df, rule_table(spark)).collect()} == want and len(want) > 20


def test_many_rules_make_no_product(spark):
    """10,000 rules that share common words, 2,000 names: candidates are
    found by each rule's rarest word."""
    rules = [(f"metric {k}", "percent", [f"mean metric score no{k}"]) for k in range(10_000)]
    df = spark.createDataFrame([(k, f"The mean metric score no{3 * k} of all", "50") for k in range(2_000)] + [(-1, "mean metric score", "50")],
                               "id long, metric string, value string")
    table = rule_table(spark, rules)
    assert rule_candidates(df.select(F.col("metric").alias("name")), table).count() == 2_000
    got = {r.id: r.standardized_metric for r in standardize_metric_by_rules(df, table).collect()}
    assert got == {k: f"metric {3 * k}" for k in range(2_000)}
    odd = rule_table(spark, [("none", "percent", ["%", ""]), ("late", "percent", ["Score"]), ("early", "percent", ["score"])])
    odd = odd.withColumn("priority", F.when(F.col("standard") == "early", 0).otherwise(5).cast("long"))
    assert {r.standardized_metric for r in standardize_metric_by_rules(df, odd).collect()} == {"early"}
    assert len(METRIC_RULES) == 13
