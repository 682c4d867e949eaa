import hashlib
import random
import re

import data
import numpy as np

from pyspark.sql import functions as F

from chunklake.llm import exact_dedup, simhash, suffix_dedup
from chunklake.llm.common import scratch_path


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_decisions(spark):
    rows = data.documents()
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "t"), 4)
    got = exact_dedup.decisions(data.frame(spark), index).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, *_ in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_index_persists_and_is_anti_joined(spark):
    path = scratch_path(spark, "t")
    a, b = data.documents()[:40], data.documents()[30:]
    first = exact_dedup.deduplicated(data.frame(spark, a), exact_dedup.DigestIndex(spark, path, 4)).count()
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert again.rows().count() == first == len({norm(t) for _, t, *_ in a})
    new = exact_dedup.deduplicated(data.frame(spark, b), again)
    assert {norm(r.text) for r in new.collect()} == {norm(t) for _, t, *_ in b} - {norm(t) for _, t, *_ in a}
    batch = exact_dedup.digests(data.frame(spark, b)).groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    plan = again.met(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1
    assert exact_dedup.decisions(data.empty(spark), exact_dedup.DigestIndex(spark, scratch_path(spark, "t"), 2)).count() == 0


def test_later_batches_keep_who_came_first(spark):
    one = [(5, "a b", "en", "s", 1), (6, "c", "en", "s", 1), (7, "a  b", "en", "s", 1)]
    two = [(1, "a\nb", "en", "s", 1), (2, "new", "en", "s", 1), (None, "c", "en", "s", 1)]
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "t"), 4)
    first = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(data.frame(spark, one), index).collect()}
    assert first == {5: (5, 2, True), 6: (6, 1, True), 7: (5, 2, False)}
    then = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(data.frame(spark, two), index).collect()}
    assert then == {1: (5, 3, False), 2: (2, 1, True), None: (6, 2, False)}
    assert {r.keep_id: r.group_size for r in index.rows().collect()} == {5: 3, 6: 2, 2: 1}
    index.close()


def near_texts():
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(len(w))] = f"v{r.randrange(9)}"
        rows.append((i, " ".join(w), "en", "a", 1))
    for i in range(300, 360):
        rows.append((i, " ".join(f"x{r.randrange(10**6)}" for _ in range(60)), "en", "a", 1))
    return rows


def brute_components(ids, fps, most):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    fps = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= most):
            parent[find(i)] = find(i + 1 + int(j))
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(find(k), []).append(i)
    return [min((x for x in groups[find(k)] if x is not None), default=None) for k in range(len(ids))]


def plain_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rows = data.documents() + [(i + 1000, *rest) for i, *rest in near_texts()]
    got = {}
    for r in simhash.clustered(data.frame(spark, rows)).collect():
        got.setdefault((r.doc_id, r.fingerprint), set()).add(r.component_id)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    for (i, _t, *_), fp, c in zip(rows, fps, brute_components([r[0] for r in rows], fps, 3), strict=True):
        assert got[i, f"{fp:016x}"] == {c}


def test_crowded_buckets_lose_no_component(spark):
    rows = near_texts()
    own = simhash.fingerprints(data.frame(spark, rows)).cache()
    nodes = own.select("node").dropDuplicates(["node"])
    from chunklake.llm.components import components

    want = {tuple(r) for r in components(simhash.links(nodes, hot=10**9)).collect()}
    assert {tuple(r) for r in components(simhash.links(nodes, hot=4, pivots=2)).collect()} == want


def test_components_of_a_chain_and_a_star(spark):
    from chunklake.llm.components import components

    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 50)} == {1}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
