"""Personal data: base patterns, the fitted field, redaction."""

import random
import re

from tablemine.llm import pii as P

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _base(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(6)
    texts = ["".join(r.choice("a1@.+- ()b9%\né") for _ in range(r.randint(0, 40))) for _ in range(5000)]
    texts += ["x 4111 1111 1111 1111 y", "4111111111111111", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0001.002.03.4", "+1 (447) 555-7684."]
    for t in texts:
        assert P.base_spans(t) == _base(t), t


def test_held_out_accuracy():
    field = P.fitted()
    right = found = there = 0
    for text, spans in P._examples(300, seed=99):
        words = [m.span() for m in P._WORD.finditer(text)]
        got = {(P.TYPES[y], *P.trimmed(text, words[i][0], words[i + d - 1][1])) for i, d, y in field.best(text, words) if y}
        gold = {(k, *P.trimmed(text, a, b)) for k, a, b in spans}
        right, found, there = right + len(got & gold), found + len(got), there + len(gold)
    assert right / found > 0.93 and right / there > 0.93


def test_held_out_recall_through_the_seeds():
    field = P.fitted()
    found = there = 0
    for text, spans in P._examples(300, seed=99):
        for text, spans in ((text, spans), (text.replace("[", "(").replace("]", ")"), spans)):
            base = P.base_spans(text)
            got = {(k, *P.trimmed(text, a, b)) for k, a, b in [*base, *P.added_spans(text, base, field)]}
            gold = {(k, *P.trimmed(text, a, b)) for k, a, b in spans}
            found, there = found + len(got & gold), there + len(gold)
    assert found / there > 0.93


def test_addresses_spelled_with_round_brackets():
    field = P.fitted()
    for address in ("jane (at) example (dot) com", "jane(at)example(dot)com", "jane (AT) example.com"):
        text = f"write to {address} for more"
        assert ("email", 9, 9 + len(address)) in P.added_spans(text, P.base_spans(text), field), address


def test_best_cut_is_the_best_of_all():
    """The dynamic program against all cuts of a short sequence."""
    field = P.fitted()
    text = "call 555-123-4567 or 7 at"
    words = [m.span() for m in P._WORD.finditer(text)]
    scores = field.scores(field.segments(text, words))

    def cuts(i, last):
        if i == len(words):
            yield 0.0, []
            return
        for d in range(1, min(P.MAX_WORDS, len(words) - i) + 1):
            for y in range(len(P.TYPES)):
                for s, rest in cuts(i + d, y):
                    yield s + scores[i, d][y] + field.moves[last, y], [(i, d, y), *rest]

    assert field.best(text, words) == max(cuts(0, 0), key=lambda x: x[0])[1]


def test_operator(spark):
    texts = [None, "", "no data here", "write to ann.b@mail.example.com or call (555) 123-4567 now", "host 10.0.0.1 é 10.0.0.1",
             "number 1234567890123456 in 2024-05-01, version 2.0", 'é token = "6af31479022cf0d6b3812396be887d7b6d2a35a6" end',
             "x" * 100_000 + " 1" * 5000]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in P.find_personal_data(docs, redact=True).collect()}
    for i, t in enumerate(texts):
        assert got[i].base == P._joined(_base(t or ""))
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert got[0].redacted is None and got[1].redacted == "" and got[2].redacted == texts[2]
    assert got[3].redacted == "write to <EMAIL> or call <PHONE> now"
    assert got[4].redacted == "host <IP> é <IP>"
    assert got[5].redacted == texts[5]
    assert "6af3" not in got[6].redacted and got[6].redacted.endswith("end")
    assert P.find_personal_data(docs.limit(0)).count() == 0


def test_redaction_of_overlaps():
    assert P.redacted("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a<IP>f"
    assert P.redacted("abc", []) == "abc"


def test_long_runs_of_digits_are_linear():
    import re
    import time

    from tablemine.llm import pii as P
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    samples = ["1" * 300, "12." * 90, "0" * 99 + "1.2.3.4", "1.2.3.4.5.6.7.8.9", "1..2.3.4.5", "a1.2.3.4b5.6.7.8", "999.1.1.1.1", "1.2.3", ".1.2.3.4.",
               "1.2.3.4" + "5" * 200, "00.00.00.00"]
    for t in samples:
        want = [("ip", *m.span()) for m in plain.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [x for x in P.base_spans(t) if x[0] == "ip"] == want, t
    field = P.fitted()
    for t in ("7" * 1_000_000, "1." * 500_000, "0" * 1_000_000 + "1.1.1.1", "1 " * 20_000, "12-" * 300_000):
        start = time.process_time()
        P.base_spans(t)
        assert time.process_time() - start < 2, t[:9]
    assert ("ip", 0, 1_000_007) in P.base_spans("0" * 1_000_000 + "1.1.1.1")
    start = time.process_time()
    P.added_spans("7" * 1_000_000, P.base_spans("7" * 1_000_000), field)
    assert time.process_time() - start < 2
