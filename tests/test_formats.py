import gzip

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunklake.functions import codecs
from chunklake.sources import formats as f
from chunklake.sources import readers

U = lambda n: st.integers(0, 2**n - 1)
I32 = st.integers(-(2**31), 2**31 - 1)
ENVELOPES = st.fixed_dictionaries({"record_ver": U(8), "type_id": U(16), "comp_id": U(8), "x": I32, "z": I32, "gen": U(64), "epoch_ts": U(32), "payload_len": U(32), "payload_hash": U(64)})


@given(ENVELOPES)
def test_envelope_round_trip(e):
    data = f.envelope(**e)
    assert len(data) == 40 and f.parse_envelope(data) == e


@given(st.lists(st.binary(max_size=80), min_size=1, max_size=6), st.data())
def test_segment_scan(payloads, data):
    body = [f.record(p, x=i, z=-i, type_id=0, gen=i + 1) for i, p in enumerate(payloads)]
    whole = f.segment_header(7) + b"".join(body)
    s = f.scan_segment(whole)
    assert s.seg_id == 7 and [r["payload"] for r in s.records] == payloads and not s.truncated_tail
    assert f.scan_segment(whole[: -data.draw(st.integers(1, len(body[-1]) - 1))]).truncated_tail


def test_segment_damage():
    a, b = f.record(b"abc", gen=1), f.record(b"defg", gen=2)
    bad = bytearray(f.segment_header(1) + a + b)
    bad[16 + 40] ^= 1
    s = f.scan_segment(bytes(bad))
    assert [(r["is_corrupt"], r["payload_hash"] == 0) for r in s.records] == [(True, True), (False, False)]
    s = f.scan_segment(f.segment_header(1) + a + b"\xee" * 100 + b)
    assert len(s.records) == 2 and s.resyncs == 1
    with pytest.raises(f.FormatError):
        f.scan_segment(f.segment_header(1) + a + b"\xee" * (f.RESYNC_WINDOW + 100) + b)
    with pytest.raises(f.FormatError):
        f.scan_segment(b"nope")
    assert f.segment_header_ok(bytes(bad), 1) and not f.segment_header_ok(bytes(bad), 2)


def test_epoch_log_stops_at_a_torn_or_bad_entry():
    rows = [f.log_entry(i, f.envelope(gen=i, x=-i), i * 100) for i in range(4)]
    assert [r["seg_id"] for r in f.scan_log(b"".join(rows))] == [0, 1, 2, 3]
    assert len(f.scan_log(b"".join(rows)[:-3])) == 3
    assert len(f.scan_log(rows[0] + bytes(64) + rows[1])) == 1


PAGE_ROW = st.fixed_dictionaries({"x": I32, "z": I32, "type_id": U(16), "seg_id": U(32), "offset": U(63), "payload_len": U(32), "gen": U(63), "comp_id": U(8)})


@given(st.lists(PAGE_ROW, max_size=12))
def test_index_page_round_trip(rows):
    parsed = f.parse_page(f.page(rows))
    keys = [(r["x"], r["z"], r["type_id"]) for r in parsed]
    assert keys == sorted({(r["x"], r["z"], r["type_id"]) for r in rows})
    for r in parsed:
        assert r["gen"] == max(o["gen"] for o in rows if (o["x"], o["z"], o["type_id"]) == (r["x"], r["z"], r["type_id"]))
    if rows:
        with pytest.raises(f.FormatError):
            f.parse_page(f.page(rows) + b"x")
        with pytest.raises(f.FormatError):
            f.parse_page(f.page(rows)[:-1])


@given(st.integers(0, 2**32 - 1))
def test_varint(n):
    assert f.read_varint(f.varint(n), 0) == (n, len(f.varint(n)))


def test_manifest():
    seg = [{"id": 1, "live_bytes": 5, "total_bytes": 9, "bucket": "active", "created_epoch": 2, "last_rewrite_epoch": 3}]
    cold = [{"region_x": -1, "region_z": 2, "invalid_count": 0, "total_slots": 7}]
    data = f.manifest(4, 5, 6, seg, cold, [(0, b"dict")])
    m = f.parse_manifest(data)
    assert (m["epoch"], m["next_gen"], m["next_seg_id"], m["segments"], m["cold"], m["dictionaries"]) == (4, 5, 6, seg, cold, [(0, b"dict")])
    for bad in (data[:-1], data + b"x", bytes([data[0] ^ 1]) + data[1:]):
        with pytest.raises(f.FormatError):
            f.parse_manifest(bad)


@settings(max_examples=25)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 31), st.integers(0, 2), st.binary(max_size=100)), max_size=90))
def test_archive_round_trip(rows):
    own = [{"x": x - 32, "z": z + 64, "type_id": t, "gen": i, "epoch_ts": 1, "comp_id": 1, "payload": p} for i, (x, z, t, p) in enumerate(rows)]
    data = f.archive(-1, 2, own)
    got = {(r["x_rel"], r["z_rel"], r["type_id"]): r["payload"] for r in f.parse_archive(data)}
    assert got == {(x, z, t): p for x, z, t, p in rows}
    distinct = list({(x, z, t): r for (x, z, t, _), r in zip(rows, own, strict=True)}.values())
    assert f.archive(-1, 2, distinct) == f.archive(-1, 2, distinct[::-1])


def test_archive_damage_and_invalid_bits():
    data = f.archive(0, 0, [{"x": i, "z": 0, "type_id": 0, "gen": i, "epoch_ts": 0, "comp_id": 0, "payload": b"p" * 50} for i in range(9)])
    assert [r["invalid"] for r in f.parse_archive(data, b"\x05\x01")] == [True, False, True, False, False, False, False, False, True]
    for bad in (data[:10], b"XXXX" + data[4:], data[:40]):
        with pytest.raises(f.FormatError):
            f.parse_archive(bad)
    with pytest.raises(f.FormatError):
        f.parse_archive(data, b"\0")


@settings(max_examples=25)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 31), st.binary(max_size=9000), U(32)), max_size=8, unique_by=lambda r: r[:2]))
def test_region_round_trip(rows):
    own = [{"x_rel": x, "z_rel": z, "nbt": b, "timestamp": t} for x, z, b, t in rows]
    got = f.parse_region(f.region_file(own))
    key = lambda r: (r["z_rel"], r["x_rel"])
    assert [{k: r[k] for k in ("x_rel", "z_rel", "nbt", "timestamp")} for r in sorted(got, key=key)] == sorted(own, key=key)


def test_region_damage_and_versions():
    import os

    with pytest.raises(f.FormatError):
        f.region_file([{"x_rel": 0, "z_rel": 0, "nbt": os.urandom(256 * 4096)}])
    head = (2 << 8 | 1).to_bytes(4, "big") + bytes(2 * 4096 - 4)
    for version, body in ((1, gzip.compress(b"abc")), (3, b"abc"), (4, (12).to_bytes(4, "big") + b"\x31abc\x03\x00\x50aaaaa"[:11])):
        if version == 4:
            body = (8).to_bytes(4, "big") + b"\x31abc\x03\x00"  # 3 literals, then 5 bytes from 3 back
        data = head + (len(body) + 1).to_bytes(4, "big") + bytes([version]) + body
        assert f.parse_region(data.ljust(3 * 4096, b"\0"))[0]["nbt"] == (b"abcabcab" if version == 4 else b"abc")
    exact = head + (4092).to_bytes(4, "big") + b"\x03" + b"z" * 4091
    assert len(f.parse_region(exact)[0]["nbt"]) == 4091
    for bad in ((1 << 8 | 1).to_bytes(4, "big") + bytes(3 * 4096), head + (9).to_bytes(4, "big") + b"\x83" + bytes(4091), head + (9).to_bytes(4, "big") + b"\x04\xff\xff\xff\xff" + bytes(4087)):
        with pytest.raises(f.FormatError):
            f.parse_region(bad)


def test_codecs():
    assert codecs.decode(codecs.encode(b"abc" * 99, 1), 1) == b"abc" * 99
    with pytest.raises(codecs.CodecError):
        codecs.decode(b"x", 9)
    with pytest.raises(codecs.CodecError):
        codecs.decode(b"not zstd", 1)
    with pytest.raises(codecs.CodecError):
        codecs.encode(b"x", 1, 0)
    assert codecs.gunzipped(codecs.gzipped(b"a")) == b"a" and codecs.gunzipped(b"raw") == b"raw"
    d = codecs.train_dictionary([b"a common head %d" % i * 99 for i in range(200)], 4096)
    assert codecs.decode(codecs.encode(b"a common head 7", codecs.comp_id(1, 2), 3, {2: d}), codecs.comp_id(1, 2), {2: d}) == b"a common head 7"
    assert codecs.train_dictionary([b"x"] * 99) is None


def test_scans_on_files(spark, tmp_path):
    (tmp_path / "seg-1.vseg").write_bytes(f.segment_header(1) + f.record(b"abc", gen=1, x=-5) + f.record(b"", gen=2))
    (tmp_path / "current.velog").write_bytes(f.log_entry(1, f.envelope(gen=1), 16))
    (tmp_path / "1.vix").write_bytes(f.page([{"x": 1, "z": 2, "type_id": 0, "seg_id": 1, "offset": 16, "payload_len": 3, "gen": 1, "comp_id": 0}]))
    (tmp_path / "r.0.0.varc").write_bytes(f.archive(0, 0, [{"x": 1, "z": 2, "type_id": 0, "gen": 1, "epoch_ts": 0, "comp_id": 0, "payload": b"q"}]))
    (tmp_path / "r.0.0.varc.inv").write_bytes(b"\x01")
    (tmp_path / "r.-1.0.mca").write_bytes(f.region_file([{"x_rel": 3, "z_rel": 4, "nbt": b"n", "timestamp": 9}]))
    at = tmp_path.as_uri()
    assert [(r.gen, r.x, bytes(r.payload), r.is_corrupt) for r in readers.segments(spark, at).orderBy("gen").collect()] == [(1, -5, b"abc", False), (2, 0, b"", False)]
    assert readers.epoch_log(spark, at).first().offset == 16
    assert readers.index_pages(spark, at).first().payload_len == 3
    assert readers.archives(spark, at).first().invalid is True
    r = readers.region_files(spark, at).first()
    assert (r.x, r.z, bytes(r.nbt), r.timestamp) == (-29, 4, b"n", 9)
    assert readers.directory_size(spark, at).first().files == 6


def test_manifest_falls_back_to_its_copy(spark, tmp_path):
    good = lambda n: f.manifest(n, 5, 2, [], [])
    for name, main, copy in (("a", good(3), good(2)), ("b", b"broken", good(2)), ("c", None, good(1))):
        (tmp_path / name).mkdir()
        for file, data in ((readers.MANIFEST, main), (readers.MANIFEST_COPY, copy)):
            if data:
                (tmp_path / name / file).write_bytes(data)
    got = {r.path.split("/")[-2]: (r.copy, r.epoch) for r in readers.manifests(spark, tmp_path.as_uri()).collect()}
    assert got == {"a": (readers.MANIFEST, 3), "b": (readers.MANIFEST_COPY, 2), "c": (readers.MANIFEST_COPY, 1)}
    (tmp_path / "b" / readers.MANIFEST_COPY).write_bytes(b"too")
    with pytest.raises(Exception, match="neither"):
        readers.manifests(spark, tmp_path.as_uri()).collect()


def test_segments_and_logs_written_and_scanned(spark, tmp_path):
    rows = [(i // 4, i + 1, i - 3, -i, i % 3, i // 5, 0, bytes([i]) * (i * 7 % 20)) for i in range(12)]
    df = spark.createDataFrame(rows, "seg bigint, gen bigint, x int, z int, type_id int, epoch_ts int, comp_id int, payload binary")
    at = (tmp_path / "s").as_uri()
    placed = readers.write_segments(df, at).cache()
    assert placed.count() == 12
    scanned = readers.segments(spark, at).collect()
    assert sorted((r.seg_id, r.gen, r.x, r.z, r.type_id, bytes(r.payload)) for r in scanned) == sorted((s, g, x, z, t, p) for s, g, x, z, t, _, _, p in rows)
    assert not any(r.is_corrupt for r in scanned)
    entries = df.withColumn("payload_len", F.octet_length("payload")).drop("payload").join(placed, ["seg", "gen"])
    assert readers.write_epoch_logs(entries, at).count() == 3
    logged = {(r.seg_id, r.gen, r.offset, r.payload_hash) for r in readers.epoch_log(spark, at).collect()}
    assert logged == {(r.seg_id, r.gen, r.offset, r.payload_hash) for r in scanned}


def test_region_slots(tmp_path):
    whole = bytearray(f.region_file([{"x_rel": 1, "z_rel": 0, "nbt": b"n", "timestamp": 0}]))
    whole[8:12] = (2 << 8).to_bytes(4, "big")  # a place without sectors is no chunk
    assert len(f.parse_region(bytes(whole))) == 1
    with pytest.raises(f.FormatError):
        f.parse_region(b"")
