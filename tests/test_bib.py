"""BibTeX title look-up and title matching."""

from collections import Counter

from pyspark.sql import functions as F

from tablemine.operators.bib import bib_title_lookup, title_match


def test_bib_lookup(spark):
    bib = ("% comment\n@article{alpha,\n  booktitle = {Proc},\n  title = {Alpha {Set}},\n}\n"
           "@article{dup,\n title={D1}}\n@article{dup,\n title={D2}}\n"
           "@article{far,\n a\n b\n c\n d\n e\n f\n g\n h\n i\n title = {Too far}\n}\n"
           "@article{next,\n}\n@misc{other,\n title = {Other}\n}\n")
    files = spark.createDataFrame([("p", "refs.bib", bib)], "paper_id string, rel_path string, content string")
    cites = spark.createDataFrame([("p", t) for t in ["alpha", "dup", "far", "next", "none"]],
                                  "paper_id string, dataset_citation_tag string")
    got = {r.tag: r.title for r in bib_title_lookup(files, cites).collect()}
    assert got == {"alpha": "Alpha {Set}", "dup": None, "far": "Too far", "next": None, "none": None}


def test_bib_lookup_by_a_line_that_holds_the_tag(spark):
    import random
    rnd = random.Random(7)
    heads, bibs, tags = {}, [], []
    for paper in ("p", "q", "none"):
        keys = ["".join(rnd.choice("ab1") for _ in range(rnd.randint(1, 5))) for _ in range(12)]
        heads[paper] = [(f"  @misc{{{k}, x = {{é}}", f"T{n}") for n, k in enumerate(keys)] if paper != "none" else []
        bibs += [(paper, "".join(f"{h},\n  title = {{{t}}},\n}}\n" for h, t in heads[paper]))]
        tags += [(paper, t) for t in {*keys, "a", "b1a", "é", "misc", "", "x" * 60, "@misc{a"}] + [(paper, None)]
    files = spark.createDataFrame(bibs, "paper_id string, content string")
    cites = spark.createDataFrame(tags, "paper_id string, tag string")
    got = {(r.paper_id, r.tag): r.title for r in bib_title_lookup(files, cites, "tag", containing=True).collect()}
    want = {}
    for paper, tag in tags:
        held = [t for h, t in heads[paper] if tag is not None and tag in h + ","]
        want[paper, tag] = held[0] if len(held) == 1 else None
    assert got == want and any(want.values())


def test_links_with_and_without_a_table_of_matches(spark):
    from tablemine.operators.bib import link_columns
    recs = spark.createDataFrame([(1, "2301.00001", "2401.7"), (2, "2301.00002", None), (3, "x", "2401.8")],
                                 "id int, paper_id string, arxiv_id string")
    own = link_columns(recs, None, [], "/s/").collect()
    joined = link_columns(recs.drop("arxiv_id"), recs.select("id", "arxiv_id"), ["id"], "/s/").collect()
    assert sorted(own) == sorted(joined)
    assert {r.id: (r.dataset_link, r.external_source_path) for r in own} == {
        1: ("2401.7", "/s/2401.7"), 2: ("", ""), 3: ("", "")}


def _macro_f1(a, b):
    ca, cb = Counter(a), Counter(b)
    vocab = set(ca) | set(cb)
    x = [ca[v] for v in vocab]
    y = [cb[v] for v in vocab]
    classes = set(x) | set(y)
    s = 0.0
    for c in classes:
        tp = sum(1 for i, j in zip(x, y) if i == c and j == c)
        n = x.count(c) + y.count(c)
        s += 2 * tp / n if n else 0.0
    return s / len(classes)


def test_title_match_scores(spark):
    wanted = spark.createDataFrame([(1, "{Deep} Nets for Tables"), (2, "a b c")], "id int, title string")
    cands = spark.createDataFrame([
        ("http://x/abs/2401.00001v1", "Deep nets for tables"),
        ("http://x/abs/2401.00002v1", "Deep nets nets for tables"),
        ("http://x/abs/2401.00003v1", "Nets for tables")], "arxiv_url string, title string")
    got = {r.id: (r.arxiv_id, r.f1) for r in title_match(wanted, cands).collect()}
    assert got[1] == ("2401.00001", 1.0)
    assert got[2] == (None, None)



def test_macro_f1_matches_direct_computation(spark):
    from tablemine.operators.bib import macro_f1, title_tokens, token_counts
    pairs = [("deep nets nets for tables", "deep nets for tables"), ("ab cd ef", "ab cd ef"),
             ("xx xx xx xx xx yy yy yy yy zz zz zz ww ww vv", "xx xx xx xx xx yy yy yy yy zz zz zz ww ww uu"),
             ("alpha beta", "alpha gamma"), ("one one two", "one two two")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(macro_f1(token_counts(title_tokens(F.col("a"))),
                             token_counts(title_tokens(F.col("b")))).alias("f")).collect()
    for (a, b), r in zip(pairs, got):
        assert abs(r.f - _macro_f1(a.split(), b.split())) < 1e-9

def test_title_match_all_keeps_titles_without_a_match(spark, tmp_path):
    from tablemine.plans.q_entities import q_title_match, q_title_match_all
    parts = [(3, "red steel", "small case"), (4, "blue brass", "large box"), (5, "green tin", "wide bag")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: (r.arxiv_id, r.f1) for r in q_title_match_all(spark, str(tmp_path)).collect()}
    assert got == {3: ("2401.00003", 1.0), 4: (None, None), 5: (None, None)}
    assert [r.p_partkey for r in q_title_match(spark, str(tmp_path)).collect()] == [3]


def _f1(a, b):
    """Macro-F1 of two titles, by its definition."""
    import re
    from collections import Counter
    x, y = (Counter(re.findall(r"\b\w\w+\b", t.lower())) for t in (a, b))
    pairs = [(x[k], y[k]) for k in {*x, *y}]
    classes = {v for p in pairs for v in p}
    score = [2 * sum(p == (c, c) for p in pairs) / (sum(p[0] == c for p in pairs) + sum(p[1] == c for p in pairs)) for c in classes]
    return sum(score) / len(score) if score else 0.0


def _titles(seed, n):
    """Ordinary titles and heavy ones (tokens up to seven times); one token
    stands in half of all."""
    import random
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if r.random() < 0.5:
            out.append(" ".join(r.choice(["of", "deep", "nets", "for", "tables"]) for _ in range(r.randint(0, 6))))
        else:
            base = [w for k, w in enumerate(["the", "a1", "b2", "c3", "d4", "e5", "f6", "g7"]) for _ in range(k + 1 if k < 6 else 1)]
            extra = [r.choice(["the", "xx", "yy", "g7", "h8", "i9"]) for _ in range(r.randint(0, 2))]
            words = [w for w in base if r.random() < 0.99] + extra
            r.shuffle(words)
            out.append(" ".join(words))
    return out


def test_title_match_against_all_pairs(spark, monkeypatch):
    import pytest

    from tablemine.operators import bib as B
    wanted, found = _titles(1, 60) + ["", "{Deep} nets", None], _titles(2, 120)
    w = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "i long, title string")
    c = spark.createDataFrame([(f"http://arxiv.org/abs/2401.{k:05d}", t) for k, t in enumerate(found)], "arxiv_url string, title string")
    for block in (2_000, 3):
        monkeypatch.setattr(B, "KEY_BLOCK", block)
        got = {r.i: r for r in B.title_match(w, c).collect()}
        assert len(got) == len(wanted)
        different = 0
        for i, t in enumerate(wanted):
            clean = (t or "").replace("{", "").replace("}", "")
            scores = [(-_f1(clean, f), f"2401.{k:05d}") for k, f in enumerate(found)] if t is not None else []
            best = min((s for s in scores if -s[0] > 0.8 + 1e-12), default=None)
            assert got[i].arxiv_id == (best and best[1])
            if best:
                assert got[i].f1 == pytest.approx(-best[0])
                different += -best[0] < 0.999
        assert different > 3


def test_bound_is_above_every_score(spark):
    from tablemine.operators import bib as B
    a, b = _titles(3, 80), _titles(4, 80)
    df = spark.createDataFrame([(x, y) for x, y in zip(a, b)], "x string, y string")
    x, y = (B.token_counts(B.title_tokens(c)) for c in ("x", "y"))
    df = df.withColumn("cx", x).withColumn("cy", y).filter("size(cx) > 0 and size(cy) > 0")
    rows = df.select(B.f1_bound(B.class_sizes(F.col("cx")), B.class_sizes(F.col("cy"))).alias("bound"),
                     B.macro_f1(F.col("cx"), F.col("cy")).alias("f1")).collect()
    assert rows and all(r.bound >= r.f1 - 1e-12 for r in rows)


def test_common_token_is_no_hot_key(spark):
    """A token in half of all titles, and one token set with many vectors:
    keys are cut, so no task holds more than two blocks."""
    from tablemine.operators import bib as B
    rows = [(f"v{k}", "s-hot") for k in range(9_000)] + [(f"u{k}", f"s{k}") for k in range(50)]
    w = spark.createDataFrame(rows, "w_canon string, key string")
    c = spark.createDataFrame([(f"c{k}", "s-hot") for k in range(30)] + [("c", "s3")], "c_canon string, key string")
    met = B._meet(w, c)
    assert met.count() == 9_000 * 30 + 1
    blocks = w.groupBy("key").count().filter("key = 's-hot'").first()["count"] / B.KEY_BLOCK
    assert blocks > 4


def test_wanted_titles_are_cut_once_and_looked_up_by_text(spark):
    rows = [(k, f"{{Alpha}} set {k % 3}x") for k in range(9)] + [(9, None), (10, ""), (11, "alpha SET 1x"), (12, "none")]
    wanted = spark.createDataFrame(rows, "id int, title string")
    cands = spark.createDataFrame([(f"http://arxiv.org/abs/2401.0000{k}v1", f"Set {k}x alpha") for k in (0, 1)], "arxiv_url string, title string")
    out = title_match(wanted, cands)
    assert out.columns == ["id", "title", "arxiv_id", "f1"]
    got = {r.id: r.arxiv_id for r in out.collect()}
    assert got == {k: f"2401.0000{n}" if n < 2 else None for k in range(9) for n in [k % 3]} | {9: None, 10: None, 11: "2401.00001", 12: None}
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_citations_are_made_once_and_parts_travel_without_their_entries(spark):
    import tempfile

    from tablemine.plans.q_entities import supplier_bib_files
    at = tempfile.mkdtemp()
    pairs = [(s, p) for s in (1, 2) for p in (5, 7, 9, 9, 12)] + [(None, 5), (3, None)]
    spark.createDataFrame(pairs, "l_suppkey long, l_partkey long").write.parquet(f"{at}/lineitem.parquet")
    parts = [(5, "red nut", "BIG"), (7, "a", "b"), (9, "dup", "SMALL"), (12, None, "c")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{at}/part.parquet")
    files, cites = supplier_bib_files(spark, at)
    assert "Exchange" not in cites._jdf.queryExecution().executedPlan().toString()
    assert "booktitle" not in files._jdf.queryExecution().executedPlan().toString()  # in no partial result
    assert {(r.paper_id, r.l_partkey, r.dataset_citation_tag) for r in cites.collect() if r.l_partkey} == {
        (f"s{s}-0", p, f"ref{p:06d}") for s in (1, 2) for p in (5, 7, 9, 12)}

    def entry(s, p, title):
        return f"% part {p}\n@article{{ref{p:06d},\n  booktitle = {{Proceedings of S{s}}},\n  title = {{{title}}},\n  year = {{2024}}\n}}\n"
    assert {r.paper_id: r.content for r in files.collect()} == {
        f"s{s}-0": entry(s, 5, "red nut BIG") + 2 * entry(s, 9, "dup SMALL") for s in (1, 2)}
