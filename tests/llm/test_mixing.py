import random
import re
from collections import Counter

import data
import pytest

from chunklake.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 3 * sizes[s] if s in capped else t[s] for s in names}


def test_targets_copies_and_reruns(spark):
    df = data.frame(spark)
    got = mixing.mix(df).collect()
    rows = data.documents()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes)
    assert len(got) == len(rows)
    largest = {s: max(count(t) for _, t, _, x, _ in rows if x == s) for s in sizes}
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= largest[s]
    assert all(r.taken <= 3 * r.size for r in got)
    key = lambda rs: sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in rs)
    assert key(mixing.mix(df.repartition(7)).collect()) == key(got)


def test_whole_copies_and_unequal_probabilities(spark):
    rows = [(i, "w " * (5 if i % 2 else 500), "en", "a" if i < 400 else "b", 1) for i in range(800)]
    got = mixing.mix(data.frame(spark, rows), weights=(3, 1)).collect()
    a = [r for r in got if r.source == "a"]
    assert min(r.copies for r in a) >= 1 and {r.copies for r in a} == {1, 2}
    b = [r for r in got if r.source == "b"]
    share = lambda size: sum(r.copies for r in b if r.size == size) / sum(r.size == size for r in b)
    assert 0 < share(5) < share(500) < 1
    assert sum(r.taken for r in b) == pytest.approx(b[0].target, rel=0.01)


def brute_copies(rows, weights, half_weight=50.0):
    """Copies of each document, by sorting each source's whole ranking. rows: doc_id, source, size, level, u."""
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    out = {}
    for s, target in targets(sizes, weights).items():
        own = [r for r in rows if r.source == s]
        whole = min(3, int(target // sizes[s]))
        rest = target - whole * sizes[s]
        weight = {r.level: (x := 2.0 ** (r.level / mixing.LEVELS_PER_OCTAVE)) / (x + half_weight) for r in own}
        expected = lambda k: sum(r.size * min(1.0, k * weight[r.level]) for r in own)  # noqa: B023, E731
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if expected(mid) < rest else (low, mid)
        odds = lambda r: 0.0 if (p := min(1.0, high * weight[r.level])) >= 1 else (r.u / (1 - r.u)) / (p / (1 - p))  # noqa: B023, E731
        taken, before = set(), 0
        for r in sorted(own, key=odds):
            after = before + r.size
            if after >= rest:
                if abs(after - rest) < abs(rest - before):
                    taken.add(r.doc_id)
                break
            taken.add(r.doc_id)
            before = after
        out |= {r.doc_id: whole + (r.doc_id in taken) for r in own}
    return out


def test_copies_equal_a_sorted_ranking(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.choice([1, 3, 9, 30, 100, 700]), "en", r.choice("aaabbc"), 1) for i in range(900)]
    df = data.frame(spark, rows)
    got = {x.doc_id: x.copies for x in mixing.mix(df, weights=(1, 2, 5)).collect()}
    assert got == brute_copies(mixing.slim(df).collect(), (1, 2, 5)) and len(set(got.values())) > 2


def test_mixed_rows_follow_the_plan(spark):
    df = data.frame(spark)
    copies = {(r.doc_id, r.source, r.size): r.copies for r in mixing.mix(df).collect()}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = Counter()
    for i, t, _, s, _ in data.documents():
        n = copies[i, s, count(t)]
        want[i, t, s] += n if count(t) or n else 1  # without words: once where there are no whole copies
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == Counter({k: v for k, v in want.items() if v})
    assert mixing.mixed(data.empty(spark)).count() == 0 and mixing.mix(data.empty(spark)).count() == 0
