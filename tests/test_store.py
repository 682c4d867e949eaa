import pytest
from pyspark.sql import functions as F

from chunklake import cli, config, convert
from chunklake.sources import formats, readers
from chunklake.store import Store, StoreError
from chunklake.streaming.ingest import ingest

ROW = "x int, z int, type_id int, payload binary, order bigint"


def rows(spark, *items):
    return spark.createDataFrame([(x, z, t, p, i) for i, (x, z, t, p) in enumerate(items)], ROW)


def test_write_read_overwrite_reopen(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert s.write(rows(spark, (10, -10, 0, b"\1\2\3"), (10, -10, 1, b"\x09"))) == 2
        s.flush()
        s.write(rows(spark, (10, -10, 0, b"new"), (5, 5, 0, b"")))
        assert s.read(10, -10, 0) == ("hit", b"new")
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert s.read(10, -10, 0) == ("hit", b"new") and s.read(10, -10, 1) == ("hit", b"\x09")
        assert s.read(11, -10, 0)[0] == "miss" and s.read(5, 5, 0)[0] == "deleted"
        s.write(rows(spark, (1, 1, 1, b"x")))
        assert s.hot().agg(F.count_distinct("gen"), F.count("gen")).first()[:] == (5, 5)


def test_one_writer_and_rebuild(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "s"))
    s.write(rows(spark, (0, 0, 0, b"a"), (0, 0, 0, b"b")))
    s.close()
    with pytest.raises(StoreError):
        s.flush()
    for p in tmp_path.glob("s/pointer.*"):
        p.unlink()
    with Store.open(spark, str(tmp_path / "s")) as s:  # neither pointer nor copy: rebuilt from the parts
        assert s.read(0, 0, 0) == ("hit", b"b") and s.state()["next_gen"] == 3
    for p in tmp_path.glob("s/pointer.*"):
        p.write_text("{")
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "s"))
    with Store.rebuild(spark, str(tmp_path / "s")) as s:
        assert s.read(0, 0, 0) == ("hit", b"b") and s.state()["next_gen"] == 3


def test_a_lock_does_not_outlive_its_holder(spark, tmp_path):
    import subprocess
    import sys

    at = tmp_path / "s"
    Store.open(spark, str(at)).close()
    code = f"import fcntl, os, sys, time; f = os.open({str(at / 'lock')!r}, os.O_RDWR); fcntl.flock(f, fcntl.LOCK_EX); print('held', flush=True); time.sleep(600)"
    holder = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE)
    assert holder.stdout.readline().strip() == b"held"
    with pytest.raises(StoreError):
        Store.open(spark, str(at))
    holder.kill()  # as a crash does
    holder.wait()
    Store.open(spark, str(at)).close()


def crash_before_commit(store, monkeypatch):
    def die(state):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_commit", die)


def test_open_reconciles_what_a_crash_left(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    s = Store.open(spark, at)
    s.write(rows(spark, (0, 0, 0, b"one"), (1, 0, 0, b"two")))
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        crash_before_commit(s, m)
        s.write(rows(spark, (0, 0, 0, b"late")), batch=4, flush=True)
    s.close()
    (tmp_path / "s/hot-unfinished").mkdir()
    (tmp_path / "s/stage-left").mkdir()
    with Store.open(spark, at) as s:  # the whole part counts, with its version number, batch and flush; the others are gone
        assert s.read(0, 0, 0) == ("hit", b"late") and s.read(1, 0, 0) == ("hit", b"two")
        assert (s.state()["next_gen"], s.state()["batch"], s.state()["epoch"]) == (4, 4, 1)
        assert not (tmp_path / "s/hot-unfinished").exists() and not (tmp_path / "s/stage-left").exists()
        lost = s.state()["hot"][0]
    import shutil

    shutil.rmtree(tmp_path / "s" / lost)
    with Store.open(spark, at) as s:  # a registered part that is gone is dropped
        assert len(s.state()["hot"]) == 1 and s.read(0, 0, 0) == ("hit", b"late") and s.read(1, 0, 0)[0] == "miss"
        s.write(rows(spark, (7, 0, 0, b"x")))
        assert s.hot().agg(F.max("gen")).first()[0] == 4


def test_a_crash_of_gc_or_tier_counts_no_row_twice(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    cfg = config.Config(enabled=True, stable_flushes=1)
    s = Store.open(spark, at, cfg)
    s.write(rows(spark, *((i, 0, 0, b"a" * 50) for i in range(20))))
    s.write(rows(spark, *((i, 0, 0, b"b" * 50) for i in range(15))))
    want = sorted((r.x, r.gen) for r in s.latest().collect())
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        crash_before_commit(s, m)
        s.gc()
    s.close()
    for again in (Store.open, Store.rebuild):
        with again(spark, at, cfg) as s:
            assert sorted((r.x, r.gen) for r in s.latest().collect()) == want
            assert s.hot().count() == s.hot().select("gen").distinct().count()
    s = Store.open(spark, at, cfg)
    s.flush()
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        crash_before_commit(s, m)
        s.tier()
    s.close()
    with Store.open(spark, at, cfg) as s:
        assert sorted((r.x, r.gen) for r in s.latest().collect()) == want and s.cold().count() == 20


def test_readers_of_an_old_snapshot_go_on(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.write(rows(spark, *((i, 0, 0, b"a" * 50) for i in range(10))))
        s.write(rows(spark, *((i, 0, 0, b"b" * 50) for i in range(10))))
        before = s.latest()
        assert s.gc().removed == 1
        assert before.count() == 10  # its files are still there
        for _ in range(4):
            s.flush()
        assert not s.state()["trash"] and len(list((tmp_path / "s").glob("hot-*"))) == 1


def test_a_corrupt_latest_row_is_punched_around(spark, tmp_path):
    cfg = config.Config(enabled=True, gc_min_hole=100, hot_compression=False)
    with Store.open(spark, str(tmp_path / "s"), cfg) as s:
        s.write(rows(spark, *((i, 0, 0, b"a" * 100) for i in range(10))))
        part = s.state()["hot"][0]
        bad = spark.read.parquet(str(tmp_path / "s" / part)).withColumn("corrupt", F.col("x") == 9).collect()
        schema = spark.read.parquet(str(tmp_path / "s" / part)).schema
        state = s.state()
        s._commit(state | {"hot": [s._put(spark.createDataFrame(bad, schema), "hot", state)]})
        s.write(rows(spark, *((i, 0, 0, b"b") for i in range(9))))
        g = s.gc()
        assert (g.removed, g.compacted, g.punched, g.reclaimed_bytes) == (0, 0, 1, 900)
        assert s.read(9, 0, 0)[0] == "miss" and s.read(3, 0, 0) == ("hit", b"b") and s.verify().first().corrupt_latest == 1
        assert s.gc().punched == 0


def test_a_key_filter_reaches_the_files(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be one file
        s.write(rows(spark, *((x, z, 0, b"v") for x in range(0, 400, 7) for z in range(0, 300, 11))))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        part = spark.read.parquet(str(tmp_path / "s" / s.state()["hot"][0]))
        spans = part.groupBy(F.input_file_name()).agg(F.min("x"), F.max("x")).collect()
        assert len(spans) > 1 and sum(lo <= 70 <= hi for _, lo, hi in spans) < len(spans)
        assert "PushedFilters: [IsNotNull(x)" in part.where("x = 70 and z = 11")._jdf.queryExecution().toString()


def test_pointer_copy_is_used(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.write(rows(spark, (0, 0, 0, b"a")))
        s.flush()
        (tmp_path / "s/pointer.json").write_text("{")
        assert s.read(0, 0, 0) == ("hit", b"a")


def test_gc_removes_dead_parts_and_keeps_the_view(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.write(rows(spark, *((i, 0, 0, b"a" * 50) for i in range(20))))
        s.write(rows(spark, *((i, 0, 0, b"b" * 50) for i in range(18))))
        s.write(rows(spark, *((i, 0, 0, b"c" * 50) for i in range(18))))
        before = sorted((r.x, r.gen) for r in s.latest().collect())
        g = s.gc()
        assert (g.removed, g.compacted) == (1, 1) and g.reclaimed_bytes > 0
        assert sorted((r.x, r.gen) for r in s.latest().collect()) == before
        assert s.stats().first().records == 20 and s.verify().first().corrupt_latest == 0


def test_promote_overwrite_demote(spark, tmp_path):
    cfg = config.Config(enabled=True, stable_flushes=3)
    with Store.open(spark, str(tmp_path / "s"), cfg) as s:
        s.write(rows(spark, *((x, z, 0, b"v" * 64) for x in range(32) for z in range(2))))
        for _ in range(3):
            s.flush()
        assert s.tier().promoted == 1 and s.hot().count() == 0 and s.cold().count() == 64
        assert s.read(3, 1, 0) == ("hit", b"v" * 64)
        s.write(rows(spark, *((x, 0, 0, b"new") for x in range(17))))
        assert s.invalid().count() == 17 and s.read(3, 0, 0) == ("hit", b"new") and s.read(20, 0, 0) == ("hit", b"v" * 64)
        s.flush()
        t = s.tier()
        assert (t.demoted, t.promoted) == (1, 0) and s.cold().count() == 0
        assert s.read(3, 0, 0) == ("hit", b"new") and s.read(20, 0, 0) == ("hit", b"v" * 64) and s.latest().count() == 64
        assert s.compact() >= 1 and s.latest().count() == 64


def test_streaming_is_idempotent(spark, tmp_path):
    rows(spark, (0, 0, 0, b"a"), (1, 0, 0, b"b")).write.parquet(str(tmp_path / "in"))
    with Store.open(spark, str(tmp_path / "s")) as s:
        for _ in range(2):
            ingest(spark.readStream.schema(ROW).parquet(str(tmp_path / "in")), s, str(tmp_path / "ck")).awaitTermination()
        assert s.latest().count() == 2 and s.state()["epoch"] == 1
        rows(spark, (0, 0, 0, b"later")).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark.readStream.schema(ROW).parquet(str(tmp_path / "in")), s, str(tmp_path / "ck")).awaitTermination()
        assert s.read(0, 0, 0) == ("hit", b"later") and s.hot().count() == 3
        assert s.write(rows(spark, (9, 9, 0, b"again")), batch=0) == 0


def world(tmp_path):
    w = tmp_path / "world"
    for dim, n in ((".", 10), ("DIM-1", 5)):
        for folder in ("region", "entities"):
            (w / dim / folder).mkdir(parents=True)
            (w / dim / folder / "r.0.-1.mca").write_bytes(formats.region_file([{"x_rel": i, "z_rel": 1, "nbt": f"{dim}{folder}{i}".encode() * 20, "timestamp": 5} for i in range(n)]))
    return w


def test_convert_both_ways_and_resume(spark, tmp_path):
    w = world(tmp_path)
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert convert.convert_in(spark, str(w), s) == {"regions": 4, "records": 30, "skipped": 0}
        assert convert.convert_in(spark, str(w), s)["skipped"] == 4
        convert.convert_out(s, str(tmp_path / "out")).collect()
        key = lambda r: (r.path.split("/")[-2:], r.x, r.z, bytes(r.nbt))
        assert sorted(map(key, readers.region_files(spark, w.as_uri()).collect())) == sorted(map(key, readers.region_files(spark, (tmp_path / "out").as_uri()).collect()))
        with pytest.raises(StoreError):
            convert.convert_out(s, str(tmp_path / "out"))
        new = convert.recompress(spark, s, str(tmp_path / "s2"))
        assert new.latest().count() == 30
        new.close()


def test_convert_in_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    w = world(tmp_path)
    for i in range(1, 6):
        (w / "region" / f"r.{i}.0.mca").write_bytes(formats.region_file([{"x_rel": 1, "z_rel": 1, "nbt": b"n" * 9, "timestamp": 5}]))
    monkeypatch.setattr(convert, "BATCH", 2)
    s = Store.open(spark, str(tmp_path / "s"))
    real, calls = s.write, []

    def write(*a, **k):
        calls.append(k["marks"])
        n = real(*a, **k)
        if len(calls) == 2:
            raise KeyboardInterrupt  # after the commit, before the marks are in the progress file
        return n

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(s, "write", write)
        convert.convert_in(spark, str(w), s)
    s.close()
    with Store.open(spark, str(tmp_path / "s")) as s:
        got = convert.convert_in(spark, str(w), s)
        assert (got["skipped"], got["regions"]) == (4, 5) and s.hot().count() == 35


def test_failures_are_told_by_dimension(spark, tmp_path):
    w = world(tmp_path)
    (w / "DIM-1/region/r.7.7.mca").write_bytes(b"short")
    with Store.open(spark, str(tmp_path / "s")) as s, pytest.raises(StoreError, match="1 failed; DIM-1"):
        convert.convert_in(spark, str(w), s)
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert s.latest().where("dim = '.'").count() == 20
    (tmp_path / "link").symlink_to(w)
    assert [n for n, _ in convert.distinct_roots([("a", w), ("b", tmp_path / "link"), ("c", w / "DIM-1")])] == ["a", "c"]
    with Store.open(spark, str(w / "DIM-1/store")) as s:
        s.write(rows(spark, (0, 0, 0, b"a")))
    assert [n for n, _ in convert.stores(str(w))] == ["DIM-1"]
    with pytest.raises(StoreError):  # rows that no import made
        with Store.open(spark, str(w / "DIM-1/store")) as s:
            convert.convert_in(spark, str(w), s)


def test_recompress_swaps_and_preflight_recovers(spark, tmp_path):
    at, old, new = (tmp_path / n for n in ("s", "s.old", "s.new"))
    with Store.open(spark, str(at)) as s:
        s.write(rows(spark, (0, 0, 0, b"a" * 99), (1, 0, 0, b"b"), (0, 0, 0, b"c" * 99)))
    new.mkdir()
    assert convert.recompress_in_place(spark, str(at), config.Config(enabled=True, hot_level=9)) == 2
    assert old.exists() and not new.exists()
    with pytest.raises(StoreError):
        convert.preflight(str(at))
    at.rename(tmp_path / "lost")
    assert convert.preflight(str(at)) and at.exists() and not old.exists()
    with Store.open(spark, str(at)) as s:
        assert s.read(0, 0, 0) == ("hit", b"c" * 99)


def test_cli(spark, tmp_path, capsys):
    w = world(tmp_path)
    at = str(tmp_path / "s")
    assert cli.main(["convert-in", at, str(w)], spark) == 0
    assert cli.main(["verify", at], spark) == 0
    assert cli.main(["stats", at], spark) == 0
    assert cli.main(["compact", at], spark) == 0
    assert "30" in capsys.readouterr().out
    with Store.open(spark, at):
        assert cli.main(["stats", at], spark) == 2


def test_config(tmp_path):
    assert config.load(str(tmp_path)) == config.Config()
    c = config.parse("﻿# note\nstore.enabled=true\nstore.gc.invalid-threshold = 0.5\nstore.compression.hot=\\\n  zstd--3\n")
    assert c.enabled and c.gc_threshold == 0.5 and c.hot_level == -3
    with pytest.raises(config.ConfigError, match="line 2"):
        config.parse("store.enabled=true\nstore.index.cache-mb=x")
    assert not config.parse("store.enabled=true\nstore.compression.hot=none").hot_compression
    assert config.parse("store.enabled=false\nstore.index.cache-mb=x") == config.Config()
    with pytest.warns(UserWarning):
        config.parse("store.enabled=true\nstore.other=1")
    assert config.advice(config.Config(enabled=True, force_external=True))
