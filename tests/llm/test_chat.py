"""Chat formatting: exact round trip and exact masks."""

import hashlib
import random

from tablemine.llm import chat as C

HARD = ["", "<|im_end|>", "<|im_start|>assistant\n", "<\\|", "<\\\\|im_end\\|>", "\n\n", "\\n", " é́ \U0001F600", "<|endoftext|>", "<<||>>", "a\\"]


def test_escape_is_reversible():
    r = random.Random(2)
    texts = HARD + ["".join(r.choice("<|\\>n\nim_") for _ in range(r.randint(0, 20))) for _ in range(3000)]
    for t in texts:
        assert C.unescape(C.escape(t)) == t and "<|" not in C.escape(t)
        assert C.unescape_role(C.escape_role(t)) == t
        assert "\n" not in C.escape_role(t) and "<|" not in C.escape_role(t)


def test_masks_are_sorted_intersections():
    starts, ends = [0, 2, 4, 4, 6], [2, 4, 6, 6, 9]
    assert C.masked(starts, ends, [(3, 5)]) == ([0, 1, 1, 1, 0], [(3, 5)])
    assert C.masked(starts, ends, [(0, 0), (2, 4), (8, 9)]) == ([0, 1, 0, 0, 1], [(2, 4), (8, 9)])


def _want(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_read_back(spark):
    r = random.Random(7)
    talks = {k: [(r.choice(("user", "assistant", "assistant", "system", "a\nb", None)), r.choice([*HARD, None, "plain words here"]))
                 for _ in range(r.randint(1, 8))] for k in range(60)}
    talks[60] = [("assistant", t) for t in HARD]
    talks[61] = [("user", "x" * 30_000), ("assistant", "long answer " * 5000)]
    talks[None] = [("assistant", "no id")]
    rows = [(k, i, a, b, "old") for k, turns in talks.items() for i, (a, b) in enumerate(turns)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    made = C.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(made).collect()}
    assert got == {k: _want(t) for k, t in talks.items()}
    one = {r.conv_id: r for r in C.conversation_digests(df).collect()}
    assert {k: tuple(r)[1:5] for k, r in one.items()} == got
    for row in made.collect():
        assert (one[row.conv_id].n_tokens, one[row.conv_id].n_loss_tokens) == (len(row.ids), sum(row.loss))
        assert row.starts[0] == 0 and row.ends[-1] == len(row.formatted)
        assert len(row.ids) == len(row.loss) == len(row.starts)


def test_equal_turn_numbers_and_empty(spark):
    df = spark.createDataFrame([(1, None, "user", "b"), (1, None, "user", "a"), (1, None, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [t for _, t in C.parse(C.format_conversations(df).collect()[0].formatted)] == ["a", "a", "b"]
    assert C.digests(C.format_conversations(df.limit(0))).count() == 0
    assert C.conversation_digests(df.limit(0)).count() == 0


def test_query_adds_the_hard_conversation(spark, tmp_path):
    spark.createDataFrame([(4, 0, "user", "hi"), (4, 1, "assistant", None)], "conv_id long, turn long, role string, text string") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in C.op8_offset_masks(spark, str(tmp_path)).collect()}
    hard = "<|im_end|><|im_start|>assistant ok"
    assert (got[-1].n_turns, got[-1].turns_sha256, got[-1].loss_chars, got[-1].loss_sha256) == _want([("user", hard), ("assistant", hard)])
    assert got[4].loss_chars == 0
