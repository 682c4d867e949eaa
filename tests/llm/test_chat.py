import hashlib
from collections import defaultdict

from chunklake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def conversations():
    rows = [(1, i, "user" if i % 2 else "assistant", "word " * (5 + i * 7 % 90)) for i in range(700)]
    rows += [(2, 0, "system", "be kind"), *((2, i, "user" if i % 2 else "assistant", f"t{i} " * 150) for i in range(1, 9))]
    rows += [(3, 0, None, None), (3, 0, None, None), (3, 1, "assistant", None), (3, None, "assistant", "<turn:x>&lt;</turn>\n&amp; > \\")]
    rows += [(None, 5, "assistant", ""), (None, 6, "we>ird<&", "x"), (4, -3, "assistant", "before"), (4, 2, "assistant", "after"), (5, 0, "assistant", "long " * 5000)]
    rows += [(-7, i, r, r"\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    return rows


def test_read_back_restores_every_turn_and_target_once(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    w = chat.format_windows(df)
    got = {r.conv_id: r for r in chat.read_back(w).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for *_, r, t in own))
        loss = "".join(t for *_, r, t in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_budget_history_and_system(spark):
    df = spark.createDataFrame([(*r, 1) for r in conversations()], SCHEMA)
    w = chat.format_windows(df, new_tokens=384, history=2, history_tokens=96).collect()
    two = [r for r in w if r.conv_id == 2]
    assert len(two) > 2 and all(r.text.startswith("<turn:system>be kind</turn>\n") for r in two)
    assert all(r.text.count("be kind") == 1 for r in two)
    one = [r for r in w if r.conv_id == 1]
    assert any(r.context > 0 for r in one) and all(r.context <= 2 for r in one)
    assert all(r.tokens <= 384 + 96 for r in one)
    assert max(r.tokens for r in w if r.conv_id == 5) > 5000  # a turn is never cut


def test_where_turns_are_numbered_does_not_matter(spark):
    said = [("user" if i % 2 else "assistant", "word " * (20 + i * 13 % 70)) for i in range(60)]
    dense = [(1, i, *x) for i, x in enumerate(said)]
    places = {1: lambda i: i, 2: lambda i: 256 * i, 3: lambda i: 10**12 + 7000 * i, 4: lambda i: i * 2**30 - 2**34, 5: lambda i: i // 20 * 2**40 + i}
    rows = [(c, at(t), role, text, 1) for c, at in places.items() for _, t, role, text in dense]
    got = defaultdict(list)
    for r in chat.format_windows(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.conv_id].append((r.window, r.tokens, r.context, r.text, tuple(r.loss)))
    assert len(got[1]) > 5 and any(x[2] for x in got[1])
    assert all(sorted(got[c]) == sorted(got[1]) for c in places)


def test_total_budget_with_a_long_system_turn(spark):
    long = " ".join(f"rule{i}" for i in range(2000))
    rows = [(1, 0, "system", long, 1)] + [(1, i, "user" if i % 2 else "assistant", "word " * (10 + i * 11 % 80), 1) for i in range(1, 80)]
    w = sorted(chat.format_windows(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.window)
    assert long in w[0].text and w[0].window == 0
    for r in w[1:]:
        assert r.tokens <= 384 + 96 + 160 and r.text.startswith("<turn:system>rule0 ") and "rule155" in r.text and "rule156" not in r.text


def test_empty(spark):
    assert chat.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0
