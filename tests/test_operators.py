"""Scenarios on small logs: ties of thresholds, corrupt records, tombstones, invariants."""

import random

from pyspark.sql import functions as F

from chunklake.operators import archive, convert, gc, latest, segments, tier, verify

LOG = "gen bigint, x int, z int, type_id int, epoch_ts int, payload string, corrupt boolean"


def log(spark, rows):
    x = spark.createDataFrame(rows, LOG)
    return x.withColumn("plen", F.length("payload").cast("bigint")).withColumn("rb", F.col("plen") + 40)


def random_log(spark, n=400, seed=1):
    r = random.Random(seed)
    return log(spark, [(i, r.randrange(-40, 40), r.randrange(-4, 4), r.randrange(4), i // 10, "p" * r.randrange(90), r.random() < 0.05) for i in range(1, n)])


def test_latest_wins_and_keeps_types_apart(spark):
    df = log(spark, [(1, 0, 0, 0, 0, "old", False), (2, 0, 0, 0, 0, "new", False), (3, 0, 0, 1, 0, "other", False)])
    assert {(r.type_id, r.payload) for r in latest.latest(df).collect()} == {(0, "new"), (1, "other")}
    assert latest.point_read(df, 0, 0, 0).first().payload == "new"
    assert latest.point_read(df, 9, 9, 0).count() == 0


def test_corrupt_latest_hides_in_read_but_not_in_clean_versions(spark):
    df = log(spark, [(1, 0, 0, 0, 0, "old", False), (2, 0, 0, 0, 0, "bad", True)])
    assert latest.point_read(df, 0, 0, 0).count() == 0
    assert latest.latest_clean_gens(df).first().gen == 1
    r = verify.report(df).first()
    assert (r.records, r.corrupt_latest, r.corrupt_dead) == (2, 1, 0)


def test_every_key_has_one_live_row_and_live_is_at_most_total(spark):
    df = segments.floor_packed(random_log(spark), 2048)
    live = latest.with_liveness(df).where("live")
    assert live.count() == df.select("x", "z", "type_id").distinct().count()
    assert segments.live_bytes(df).where("live_bytes > total_bytes").count() == 0


def test_greedy_packing_matches_a_loop(spark):
    rows = random_log(spark).select("gen", "rb").orderBy("gen").collect()
    at, seg, expected = 16, 1, {}
    for r in rows:
        expected[r.gen] = seg
        at += r.rb
        if at >= 1000:
            at, seg = 16, seg + 1
    assert {r.gen: r.seg for r in segments.greedy_packed(random_log(spark), 1000).collect()} == expected


def test_touching_dead_spans_merge(spark):
    df = log(spark, [(1, 0, 0, 0, 0, "a", False), (2, 0, 0, 0, 0, "a", False), (3, 1, 0, 0, 0, "a", False), (4, 0, 0, 0, 0, "a", False)]).withColumn("seg", F.lit(0).cast("bigint"))
    assert [(r.s, r.e) for r in gc.dead_spans(df).collect()] == [(16, 98)]


def test_gc_never_deletes_or_compacts_a_corrupt_latest(spark):
    df = segments.floor_packed(random_log(spark, seed=3), 512)
    p = gc.plan(df, 0.1)
    assert p.where("action in ('delete', 'compact') and corrupt_latest > 0").count() == 0
    assert p.where("action = 'compact'").count() > 0


def test_compaction_keeps_the_latest_view(spark):
    df = segments.floor_packed(random_log(spark, seed=4), 512)
    done = gc.compacted(df, gc.plan(df, 0.3).where("action = 'compact'"), 999)
    assert sorted(r.gen for r in latest.latest(done).collect()) == sorted(r.gen for r in latest.latest(df).collect())
    assert done.count() < df.count()


def test_selection_skips_what_does_not_fit_and_goes_on(spark):
    c = spark.createDataFrame([(1, 10.0, 60), (2, 9.0, 50), (3, 8.0, 40)], "seg bigint, score double, live_bytes bigint")
    assert [r.seg for r in gc.selected(c, 100).collect()] == [1, 3]


def test_stability_is_inclusive_and_demotion_strict(spark):
    df = log(spark, [(1, 0, 0, 0, 10, "a", False), (2, 40, 0, 0, 11, "a", False)])
    epoch = spark.range(1).select(F.lit(40).alias("epoch"))
    assert {r.rx: r.stable for r in tier.stable_regions(df, epoch).collect()} == {0: True, 1: False}
    cold = tier.cold_slots(log(spark, [(i, i, 0, 0, 0, "a", False) for i in range(1, 9)]), spark.createDataFrame([(0, 0, True)], "rx int, rz int, stable boolean"))
    for n, out in ((2, 0), (3, 1)):
        bad = cold.where(F.col("gen") <= n).select("x", "z", "type_id", "rx", "rz")
        assert tier.demote_candidates(cold, bad).count() == out


def test_writeback_gets_new_versions_after_the_base(spark):
    cold = tier.cold_slots(log(spark, [(i, i, 0, 0, 0, "a", False) for i in range(1, 5)]), spark.createDataFrame([(0, 0, True)], "rx int, rz int, stable boolean"))
    bad = cold.where("gen <= 2").select("x", "z", "type_id", "rx", "rz")
    head = spark.range(1).select(F.lit(100).cast("bigint").alias("base"), F.lit(7).alias("epoch"))
    back = tier.demote_writeback(cold, bad, head).orderBy("gen").collect()
    assert [(r.gen, r.new_gen, r.epoch_ts) for r in back] == [(3, 101, 7), (4, 102, 7)]


def test_reconcile_actions(spark):
    listed = spark.createDataFrame([(0, 0), (1, 0)], "rx int, rz int")
    files = spark.createDataFrame([(0, 0, True), (2, 0, True), (3, 0, False)], "rx int, rz int, readable boolean")
    assert {r.rx: r.action for r in tier.reconciled(listed, files).collect()} == {0: "keep", 1: "drop", 2: "add", 3: "delete"}


def test_full_archive_has_16_blocks(spark):
    rows = spark.range(1024).select((F.col("id") + 1).alias("gen"), (F.col("id") % 32).cast("int").alias("x"), F.floor(F.col("id") / 32).cast("int").alias("z"), F.lit(0).alias("type_id"), F.lit(0).alias("epoch_ts"), F.repeat(F.md5(F.col("id").cast("string")), 6).alias("payload"), F.lit(False).alias("corrupt"))
    rows = latest.region_project(rows.withColumn("plen", F.length("payload").cast("bigint")).withColumn("rb", F.col("plen") + 40))
    s = archive.summary(archive.layout(rows)).first()
    assert (s.blocks, s.slots, s.plain_bytes) == (16, 1024, 1024 * 232)


def test_export_drops_tombstones_and_unknown_types(spark):
    df = log(spark, [(1, 0, 0, 0, 0, "a", False), (2, 1, 0, 0, 0, "", False), (3, 2, 0, 9, 0, "a", False)])
    assert [r.gen for r in convert.exported(df).collect()] == [1]
    r = convert.report(df).first()
    assert (r.records, r.skipped, r.tombstones) == (1, 1, 1)


def test_names_and_markers(spark):
    names = spark.createDataFrame([("r.-1.2.mca",), ("r.1.mca",)], "name string")
    assert {(r.name, r.rx, r.rz) for r in convert.parsed_names(names).collect()} == {("r.-1.2.mca", -1, 2), ("r.1.mca", None, None)}
    lines = spark.createDataFrame([(".:chunk:r0.-1",), ("x",), (".:tile:r0.0",)], "value string")
    assert [r.marker for r in convert.parsed_progress(lines).collect()] == [".:chunk:r0.-1"]


def test_dimensions_do_not_mix(spark):
    df = log(spark, [(1, 0, 0, 0, 0, "a", False), (2, 0, 0, 0, 0, "b", False)]).withColumn("dim", F.when(F.col("gen") == 1, ".").otherwise("DIM1"))
    assert latest.latest(df).count() == 2


def test_empty_log(spark):
    df = segments.floor_packed(log(spark, []), 2048)
    for x in (latest.latest(df), segments.triage(df), gc.dead_spans(df), gc.plan(df), segments.greedy_packed(df, 64)):
        assert x.count() == 0
