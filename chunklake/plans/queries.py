"""Named queries: each operator over the derived record log, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunklake.functions import scalar as X
from chunklake.operators import archive as A
from chunklake.operators import convert as C
from chunklake.operators import gc as G
from chunklake.operators import latest as L
from chunklake.operators import segments as S
from chunklake.operators import tier as T
from chunklake.operators import verify as V
from chunklake.plans.record_log import SEGMENT, Views, sql

K = ["x", "z", "type_id"]
PACK, BUDGET, CHUNK, HOLE = 65536, 20000, 100, 256
POINT, COLD_POINT, REGION = (3, 1, 0), (-32, -4, 1), (0, 0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None) -> Callable:
    def register(make: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return make

    return register


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- scans, projections, filters -------------------------------------------------------------------------------------------

query("scan_log", "SELECT gen, x, z, type_id, epoch_ts, plen, corrupt FROM rec")(lambda v: v.rec.select("gen", *K, "epoch_ts", "plen", "corrupt"))
query("region_project", "SELECT gen, rx, rz, x_rel, z_rel FROM reg")(lambda v: L.region_project(v.rec).select("gen", "rx", "rz", "x_rel", "z_rel"))
query("abs_coords", "SELECT gen, rx * 32 + x_rel AS x, rz * 32 + z_rel AS z FROM reg")(lambda v: L.abs_coords(L.region_project(v.rec).drop("x", "z")).select("gen", "x", "z"))
query("rel_coord_guard", "SELECT gen, CASE WHEN x BETWEEN 0 AND 31 THEN x END AS x_rel, CASE WHEN z + 32 BETWEEN 0 AND 31 THEN z + 32 END AS z_rel FROM rec")(
    lambda v: v.rec.select("gen", L.relative(F.col("x"), F.lit(0)).alias("x_rel"), L.relative(F.col("z"), F.lit(-1)).alias("z_rel"))
)
query("drop_corrupt", "SELECT gen, plen FROM rec WHERE NOT corrupt")(lambda v: L.without_corrupt(v.rec).select("gen", "plen"))
query("known_types", "SELECT gen, type_id FROM rec WHERE type_id IN (0, 1, 2)")(lambda v: L.known_types(v.rec).select("gen", "type_id"))
query("type_dim_join", "SELECT gen, type_id, dir, type_name FROM rec JOIN typ USING (type_id)")(lambda v: L.with_type_names(v.rec).select("gen", "type_id", "dir", "type_name"))
query("tombstones", "SELECT x, z, type_id, gen FROM lat WHERE plen = 0")(lambda v: L.tombstones(L.latest(v.rec)).select(*K, "gen"))
query("point_read", "SELECT gen, payload FROM lat WHERE x = 3 AND z = 1 AND type_id = 0 AND NOT corrupt")(lambda v: L.point_read(v.rec, *POINT).select("gen", "payload"))
query("region_scan", "SELECT x, z, type_id, gen FROM lat WHERE rx = 0 AND rz = 0")(lambda v: L.region_scan(v.rec, *REGION).select(*K, "gen"))
query("cold_point_read", "SELECT c.x, c.z, c.type_id, c.gen FROM cold c ANTI JOIN inv USING (x, z, type_id) WHERE c.x = -32 AND c.z = -4 AND c.type_id = 1")(lambda v: T.cold_point_read(v.cold, v.invalid, *COLD_POINT).select(*K, "gen"))

# --- versions --------------------------------------------------------------------------------------------------------------

query("latest_by_key", "SELECT x, z, type_id, gen, plen, md5(payload) AS payload_md5 FROM lat")(lambda v: L.latest(v.rec).select(*K, "gen", "plen", F.md5("payload").alias("payload_md5")))
query("latest_clean_gens", "SELECT x, z, type_id, gen FROM cle")(lambda v: L.latest_clean_gens(v.rec))
query("version_history", "SELECT gen, x, z, type_id, row_number() OVER w AS version, lag(gen) OVER w AS superseded_by FROM rec WINDOW w AS (PARTITION BY x, z, type_id ORDER BY gen DESC)")(
    lambda v: L.version_history(v.rec).select("gen", *K, *big("version"), "superseded_by")
)
query("liveness", "SELECT gen, live FROM liv")(lambda v: L.with_liveness(v.rec).select("gen", "live"))
query("hot_over_cold", "SELECT x, z, type_id, coalesce(h.gen, c.gen) AS gen, coalesce(h.plen, c.plen) AS plen, CASE WHEN h.gen IS NULL THEN 'cold' ELSE 'hot' END AS tier FROM hot h FULL JOIN cold c USING (x, z, type_id)")(lambda v: L.hot_over_cold(v.hot, v.cold))
query("cold_live_keys", "SELECT x, z, type_id FROM cold ANTI JOIN inv USING (x, z, type_id) ANTI JOIN hot USING (x, z, type_id)")(lambda v: L.cold_live_keys(v.hot, v.cold, v.invalid))
query("live_keys", "SELECT x, z, type_id, 'hot' AS tier FROM hot UNION ALL SELECT x, z, type_id, 'cold' FROM (SELECT * FROM cold ANTI JOIN inv USING (x, z, type_id)) ANTI JOIN hot USING (x, z, type_id)")(
    lambda v: L.live_keys(v.hot, v.cold, v.invalid)
)
query("flush_snapshot", "SELECT x, z, type_id, max(gen) AS gen, (SELECT max(epoch_ts) + 1 FROM rec) AS epoch FROM (SELECT x, z, type_id, gen FROM hla UNION ALL SELECT x, z, type_id, gen FROM cur) GROUP BY ALL")(
    lambda v: L.merged_pages(L.latest_gens(v.history), v.recent).crossJoin(F.broadcast(v.epoch))
)
query("assign_gen", "SELECT gen, (SELECT max(gen) FROM his) + row_number() OVER (ORDER BY gen) AS new_gen FROM cur")(
    lambda v: L.assigned(v.recent.crossJoin(F.broadcast(v.history.agg(F.max("gen").alias("base")))), F.col("base"), ["gen"]).select("gen", *big("new_gen"))
)
query("write_append", "SELECT gen, x, z, type_id, plen, 'history' AS part FROM his UNION ALL SELECT (SELECT max(gen) FROM his) + row_number() OVER (ORDER BY gen), x, z, type_id, plen, 'batch' FROM cur")(
    lambda v: v.history.select("gen", *K, "plen", F.lit("history").alias("part")).unionByName(
        L.assigned(v.recent.crossJoin(F.broadcast(v.history.agg(F.max("gen").alias("base")))), F.col("base"), ["gen"]).select(F.col("new_gen").alias("gen"), *K, "plen", F.lit("batch").alias("part"))
    )
)
query("batch_write", "SELECT count(*) AS written, min(gen) AS first_gen, max(gen) AS last_gen, CAST(sum(rb) AS BIGINT) AS bytes FROM cur")(
    lambda v: v.recent.agg(F.count(F.lit(1)).alias("written"), F.min("gen").alias("first_gen"), F.max("gen").alias("last_gen"), F.sum("rb").alias("bytes"))
)
query("next_gen", "SELECT greatest(max(gen) + 1, 1) AS next_gen FROM rec")(lambda v: S.next_gen(v.rec, 1))
query("rebuild_index", "SELECT x, z, type_id, gen, seg, off AS \"offset\", plen FROM ofs WHERE live")(lambda v: L.latest(S.with_offsets(v.seg)).select(*K, "gen", "seg", *big("offset"), "plen"))

# --- segments --------------------------------------------------------------------------------------------------------------

query("segment_listing", "SELECT 'seg-' || seg || '.vseg' AS name, seg AS seg_id, count(*) AS records FROM seg GROUP BY seg")(
    lambda v: S.segment_totals(v.seg).select(F.format_string("seg-%d.vseg", "seg").alias("name"), "records").withColumn("seg_id", F.regexp_extract("name", r"^seg-(\d+)\.vseg$", 1).cast("bigint"))
)
query("segment_totals", "SELECT seg, CAST(sum(rb) AS BIGINT) AS total_bytes, count(*) AS records FROM seg GROUP BY seg")(lambda v: S.segment_totals(v.seg))
query("live_bytes_by_segment", "SELECT seg, live_bytes, total_bytes FROM tri")(lambda v: S.live_bytes(v.seg))
query("store_stats", "SELECT CAST(sum(live_bytes) AS BIGINT) AS live_bytes, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, count(*) AS segments FROM tri")(lambda v: S.store_stats(v.seg))
query("segment_triage", "SELECT * FROM tri")(lambda v: S.triage(v.seg).select("seg", *big("live", "corrupt_latest", "dead", "dead_bytes", "live_bytes", "total_bytes"), "created_epoch"))
query("segment_offsets", "SELECT gen, seg, off AS \"offset\" FROM ofs")(lambda v: S.with_offsets(v.seg).select("gen", "seg", *big("offset")))
query(
    "segment_pack",
    f""", cum AS (SELECT gen, CAST(sum(rb) OVER (ORDER BY gen) AS BIGINT) AS c FROM rec),
        lo AS (SELECT CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS lo UNION ALL
            SELECT n + 1, (SELECT min(c) FROM cum WHERE c >= lo.lo + {PACK - 16}) FROM lo WHERE (SELECT min(c) FROM cum WHERE c >= lo.lo + {PACK - 16}) IS NOT NULL)
        SELECT cum.gen, max(lo.n) AS seg FROM cum JOIN lo ON cum.c > lo.lo GROUP BY cum.gen""",
)(lambda v: S.greedy_packed(v.rec, PACK))
query("region_bitmap", "SELECT seg, type_id, count(DISTINCT x_rel * 32 + z_rel) AS bits FROM seg WHERE type_id < 3 GROUP BY ALL")(lambda v: S.region_bitmap(v.seg))
query("bitmap_prefilter", "SELECT DISTINCT seg FROM seg WHERE type_id = 0 AND x_rel = 3 AND z_rel = 1")(lambda v: S.may_hold(v.seg, S.bitmaps(v.seg), *POINT))
query(
    "sort_violations",
    "SELECT seg, count(*) FILTER (WHERE bad) AS violations FROM (SELECT seg, (lag(x) OVER w, lag(z) OVER w, lag(type_id) OVER w) >= (x, z, type_id) AND lag(x) OVER w IS NOT NULL AS bad FROM seg WINDOW w AS (PARTITION BY seg ORDER BY gen)) GROUP BY seg",
)(lambda v: S.sort_violations(v.seg))
query("index_delta", "SELECT gen, x - coalesce(lag(x) OVER (PARTITION BY seg ORDER BY x, z, type_id, gen), 0) AS dx FROM seg")(lambda v: S.index_delta(v.seg).select("gen", "dx"))

# --- garbage collection ----------------------------------------------------------------------------------------------------

query("dead_spans", "SELECT * FROM spn")(lambda v: G.dead_spans(v.seg).select("seg", *big("s", "e"), "records"))
query("gc_candidates", "SELECT seg, dead_ratio FROM pln WHERE dead_ratio >= 0.6")(lambda v: G.candidates(v.seg).select("seg", "dead_ratio"))
query(
    "punch_plan",
    "SELECT o.seg, o.gen, o.off + 40 AS \"offset\", o.plen AS \"length\" FROM ofs o JOIN pln p USING (seg) JOIN spn ON spn.seg = o.seg AND o.off >= spn.s AND o.off < spn.e WHERE NOT o.live AND p.dead_ratio >= 0.6 AND p.action <> 'delete' AND spn.e - spn.s >= 256",
)(lambda v: G.punches(v.seg, min_hole=HOLE).select("seg", "gen", *big("offset", "length")))
query(
    "punch_chunks",
    f"SELECT seg, gen, off + 40 + i AS \"offset\", least({CHUNK}, plen - i) AS \"length\" FROM (SELECT o.seg, o.gen, o.off, o.plen, unnest(range(0, o.plen, {CHUNK})) AS i FROM ofs o JOIN pln p USING (seg) JOIN spn ON spn.seg = o.seg AND o.off >= spn.s AND o.off < spn.e WHERE NOT o.live AND p.dead_ratio >= 0.6 AND p.action <> 'delete' AND spn.e - spn.s >= 256)",
)(lambda v: G.punch_chunks(G.punches(v.seg, min_hole=HOLE), CHUNK).select("seg", "gen", *big("offset", "length")))
#: What the punch step takes of each segment, and what is left to compact in order of score within the budget.
PUNCHED = f""", pun AS (SELECT o.seg, o.plen FROM ofs o JOIN pln p USING (seg) JOIN spn ON spn.seg = o.seg AND o.off >= spn.s AND o.off < spn.e WHERE NOT o.live AND p.dead_ratio >= 0.6 AND p.action <> 'delete' AND spn.e - spn.s >= {HOLE}),
        hol AS (SELECT seg, CAST(sum((plen + {CHUNK - 1}) // {CHUNK}) AS BIGINT) AS holes, CAST(sum(plen) AS BIGINT) AS punched_bytes FROM pun WHERE plen > 0 GROUP BY seg),
        act AS (SELECT pln.*, coalesce(holes, 0) AS holes, coalesce(punched_bytes, 0) AS punched_bytes FROM pln LEFT JOIN hol USING (seg))"""
CHOSEN = f""", rk AS (SELECT seg, sc.live_bytes, row_number() OVER (ORDER BY -score, seg) AS r FROM sc JOIN act USING (seg) WHERE act.dead_bytes > act.punched_bytes),
        walk AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS m, CAST(NULL AS BIGINT) AS seg, false AS took UNION ALL
            SELECT rk.r, CASE WHEN m + live_bytes <= {BUDGET} THEN m + live_bytes ELSE m END, rk.seg, m + live_bytes <= {BUDGET} FROM walk JOIN rk ON rk.r = walk.r + 1)"""


def _planned(v: Views) -> DataFrame:
    return G.plan(v.seg, min_hole=HOLE, piece=CHUNK)


query("gc_plan", PUNCHED + " SELECT seg, action, dead_ratio, live_bytes, dead_bytes, holes, punched_bytes FROM act")(
    lambda v: _planned(v).select("seg", "action", "dead_ratio", *big("live_bytes", "dead_bytes", "holes", "punched_bytes"))
)
query("compaction_score", PUNCHED + " SELECT seg, score FROM sc JOIN act USING (seg) WHERE act.dead_bytes > act.punched_bytes")(lambda v: G.scored(_planned(v).crossJoin(F.broadcast(v.epoch))).select("seg", "score"))
query("compaction_select", PUNCHED + CHOSEN + " SELECT seg FROM walk WHERE took")(lambda v: G.selected(G.scored(_planned(v).crossJoin(F.broadcast(v.epoch))), BUDGET))
query(
    "gc_stats",
    PUNCHED
    + CHOSEN
    + """ SELECT count(*) FILTER (WHERE action = 'delete') AS removed, count(*) FILTER (WHERE took) AS compacted,
        CAST(coalesce(sum(holes), 0) AS BIGINT) AS holes, CAST(coalesce(sum(punched_bytes), 0) AS BIGINT) AS punched_bytes,
        CAST(coalesce(sum(live) FILTER (WHERE took), 0) AS BIGINT) AS records_moved, CAST(coalesce(sum(live_bytes) FILTER (WHERE took), 0) AS BIGINT) AS moved_bytes,
        CAST(coalesce(sum(total_bytes) FILTER (WHERE action = 'delete'), 0) + coalesce(sum(punched_bytes), 0) + coalesce(sum(total_bytes - live_bytes - punched_bytes) FILTER (WHERE took), 0) AS BIGINT) AS reclaimed_bytes
        FROM act LEFT JOIN (SELECT seg, took FROM walk WHERE took) USING (seg)""",
)(lambda v: G.stats(_planned(v).crossJoin(F.broadcast(v.epoch)), BUDGET).select(*big("removed", "compacted", "holes", "punched_bytes", "records_moved", "moved_bytes", "reclaimed_bytes")))
query("compact_apply", "SELECT gen, CASE WHEN action = 'compact' THEN 1000000 ELSE seg END AS seg FROM seg JOIN pln USING (seg) WHERE action <> 'compact' OR seg.live")(
    lambda v: G.compacted(v.seg, G.acted(S.triage(v.seg)).where("action = 'compact'"), 1_000_000).select("gen", "seg")
)
query("bucket_advance", "SELECT seg, CASE WHEN seg % 3 = 0 THEN 'active' WHEN seg % 3 = 1 THEN 'active' ELSE 'stable' END AS bucket FROM tri")(
    lambda v: G.advanced_buckets(S.segment_totals(v.seg).withColumn("bucket", F.element_at(F.array(F.lit("young"), F.lit("active"), F.lit("stable")), (F.col("seg") % 3 + 1).cast("int"))), 2).select("seg", "bucket")
)

# --- tiers -----------------------------------------------------------------------------------------------------------------

query("region_last_write", "SELECT rx, rz, count(*) AS slots, max(epoch_ts) AS last_write FROM lat GROUP BY ALL")(lambda v: T.region_last_write(v.rec))
query("stable_regions", "SELECT rx, rz, count(*) AS slots, max(epoch_ts) AS last_write, max(epoch_ts) + 30 <= (SELECT max(epoch_ts) + 1 FROM rec) AS stable FROM lat GROUP BY rx, rz")(
    lambda v: T.stable_regions(v.rec, v.epoch).select("rx", "rz", "slots", "last_write", "stable")
)
query("promote_plan", "SELECT h.gen, h.rx, h.rz FROM hla h SEMI JOIN hst USING (rx, rz) ANTI JOIN (SELECT * FROM hla WHERE corrupt) b USING (rx, rz)")(lambda v: T.promote_plan(v.history, v.history_stable).select("gen", "rx", "rz"))
query("purge_promoted", "SELECT gen FROM hla ANTI JOIN hst USING (rx, rz)")(lambda v: L.purge(L.latest(v.history), v.history_stable.where("stable")).select("gen"))
query("cold_extract_all", "SELECT c.rx, c.rz, c.z_rel, c.x_rel, c.type_id, c.gen, i.x IS NOT NULL AS invalid FROM cold c LEFT JOIN inv i ON c.x = i.x AND c.z = i.z AND c.type_id = i.type_id")(
    lambda v: v.cold.join(v.invalid.select(*K, F.lit(True).alias("bad")), K, "left").select("rx", "rz", "z_rel", "x_rel", "type_id", "gen", F.coalesce("bad", F.lit(False)).alias("invalid"))
)
query("cold_invalidate", "SELECT x, z, type_id, rx, rz FROM inv")(lambda v: v.invalid)
query("cold_invalid_ratio", "SELECT * FROM rat")(lambda v: T.invalid_ratio(v.cold, v.invalid))
query("demote_candidates", "SELECT * FROM rat WHERE ratio > 0.25")(lambda v: T.demote_candidates(v.cold, v.invalid))
query("demote_writeback", "SELECT c.gen, (SELECT max(gen) FROM rec) + row_number() OVER (ORDER BY c.gen) AS new_gen, (SELECT max(epoch_ts) + 1 FROM rec) AS epoch_ts FROM cold c SEMI JOIN (SELECT * FROM rat WHERE ratio > 0.25) r USING (rx, rz) ANTI JOIN inv USING (x, z, type_id)")(
    lambda v: T.demote_writeback(v.cold, v.invalid, v.head).select("gen", *big("new_gen"), "epoch_ts")
)
query("tier_stats", "SELECT (SELECT count(*) FROM (SELECT DISTINCT rx, rz FROM hla SEMI JOIN hst USING (rx, rz) ANTI JOIN (SELECT * FROM hla WHERE corrupt) b USING (rx, rz))) AS promoted, count(*) FILTER (WHERE ratio > 0.25) AS demoted, count(*) FILTER (WHERE NOT ratio > 0.25) AS kept, CAST(coalesce(sum(b) FILTER (WHERE NOT ratio > 0.25), 0) AS BIGINT) AS cold_bytes FROM rat JOIN (SELECT rx, rz, sum(rb) AS b FROM cold GROUP BY ALL) USING (rx, rz)")(
    lambda v: T.tier_stats(v.cold, v.invalid).crossJoin(T.promote_plan(v.history, v.history_stable).agg(F.count_distinct("rx", "rz").alias("promoted")))
)
query(
    "reconcile_cold",
    "SELECT rx, rz, CASE WHEN l.rx IS NOT NULL AND f.rx IS NOT NULL THEN 'keep' WHEN l.rx IS NOT NULL THEN 'drop' WHEN readable THEN 'add' ELSE 'delete' END AS action FROM (SELECT DISTINCT rx, rz FROM reg WHERE (rx + rz) % 2 = 0) l FULL JOIN (SELECT DISTINCT rx, rz, rx > 5 AS readable FROM reg WHERE rx % 3 <> 0) f USING (rx, rz)",
)(
    lambda v: T.reconciled(
        L.region_project(v.rec).where("(rx + rz) % 2 = 0").select("rx", "rz").distinct(), L.region_project(v.rec).where("rx % 3 <> 0").select("rx", "rz", (F.col("rx") > 5).alias("readable")).distinct()
    )
)
query("replay_filter", "SELECT o.gen FROM (SELECT o.* FROM ofs o SEMI JOIN cur USING (gen)) o JOIN (SELECT seg, CAST(16 + sum(rb) AS BIGINT) - CASE WHEN seg % 5 = 0 THEN 100 ELSE 0 END AS size FROM seg WHERE seg % 7 <> 0 GROUP BY seg) s USING (seg) ANTI JOIN hst USING (rx, rz) WHERE o.off < size AND o.off + o.rb <= size")(lambda v: _replayable(v).select("gen"))
query("replay_apply", "SELECT x, z, type_id, max(gen) AS gen FROM (SELECT x, z, type_id, gen FROM hla UNION ALL SELECT o.x, o.z, o.type_id, o.gen FROM (SELECT o.* FROM ofs o SEMI JOIN cur USING (gen)) o JOIN (SELECT seg, CAST(16 + sum(rb) AS BIGINT) - CASE WHEN seg % 5 = 0 THEN 100 ELSE 0 END AS size FROM seg WHERE seg % 7 <> 0 GROUP BY seg) s USING (seg) ANTI JOIN hst USING (rx, rz) WHERE o.off < size AND o.off + o.rb <= size) GROUP BY ALL")(
    lambda v: L.merged_pages(L.latest_gens(v.history), _replayable(v))
)


def _replayable(v: Views) -> DataFrame:
    log = S.with_offsets(v.seg).join(v.recent.select("gen"), "gen", "left_semi")
    sizes = S.segment_totals(v.seg).where("seg % 7 <> 0").withColumn("size", F.col("total_bytes") + 16 - F.when(F.col("seg") % 5 == 0, 100).otherwise(0))
    return T.replayable(log, sizes, v.history_stable.where("stable"))


query("maintenance_ticks", "SELECT epoch_ts, count(*) AS writes, epoch_ts % 30 = 0 AS tick FROM rec GROUP BY epoch_ts")(lambda v: v.rec.groupBy("epoch_ts").agg(F.count(F.lit(1)).alias("writes")).withColumn("tick", F.col("epoch_ts") % 30 == 0))

# --- archives --------------------------------------------------------------------------------------------------------------

query("superfeatures", "SELECT gen, min_h, max_h FROM sfe")(lambda v: A.with_superfeature(v.cold, "md5").select("gen", "min_h", "max_h"))
query("archive_layout", "SELECT gen, rx, rz, rn, block, in_block FROM lay")(lambda v: A.layout(v.cold, "md5").select("gen", "rx", "rz", *big("rn", "block", "in_block")))
query("archive_offsets", "SELECT gen, CAST(40 + coalesce(sum(rb) OVER (PARTITION BY rx, rz, block ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_in_block FROM lay")(
    lambda v: A.with_offsets(A.layout(v.cold, "md5")).select("gen", *big("offset_in_block"))
)
query("block_offsets", "SELECT * FROM blk")(lambda v: A.blocks(A.layout(v.cold, "md5")).select("rx", "rz", *big("block", "records", "bytes", "file_offset")))
query("slot_table", "SELECT gen, block, row_number() OVER (PARTITION BY rx, rz ORDER BY z_rel, x_rel, type_id) - 1 AS slot FROM lay")(lambda v: A.slot_table(A.layout(v.cold, "md5")).select("gen", *big("block", "slot")))
query("archive_summary", "SELECT rx, rz, count(*) AS blocks, CAST(sum(records) AS BIGINT) AS slots, CAST(sum(bytes) AS BIGINT) AS plain_bytes, max(bytes) AS largest_block FROM blk GROUP BY ALL")(lambda v: A.summary(A.layout(v.cold, "md5")))

# --- integrity and reports -------------------------------------------------------------------------------------------------

query("verify_report", "SELECT count(*) AS records, count(*) FILTER (WHERE corrupt AND live) AS corrupt_latest, count(*) FILTER (WHERE corrupt AND NOT live) AS corrupt_dead FROM liv")(lambda v: V.report(v.rec))
query("corrupt_list", "SELECT gen, seg, off AS \"offset\", live FROM ofs WHERE corrupt")(lambda v: V.corrupt(S.with_offsets(v.seg)).select("gen", "seg", *big("offset"), "live"))
query(
    "recompress_verify",
    "SELECT CASE WHEN n.gen IS NULL THEN 'lost' WHEN o.gen IS NULL THEN 'added' WHEN o.gen = n.gen OR o.payload = n.payload THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM lat o FULL JOIN hla n USING (x, z, type_id) GROUP BY 1",
)(lambda v: V.compared(L.latest(v.rec).withColumn("h", F.md5("payload")), L.latest(v.history).withColumn("h", F.md5("payload"))))
query("stats_report", "SELECT CAST(sum(live_bytes) AS BIGINT) AS live_bytes, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, count(*) AS segments, (SELECT count(*) FROM hst) AS archives, (SELECT CAST(sum(rb) AS BIGINT) FROM cold) AS archive_bytes FROM tri")(
    lambda v: S.store_stats(v.seg).crossJoin(v.history_stable.agg(F.count_if("stable").alias("archives"))).crossJoin(v.cold.agg(F.sum("rb").alias("archive_bytes")))
)
query("footprint_ratio", "SELECT sum(rb) FILTER (WHERE live) / (SELECT sum(CAST(ceil((plen + 5) / 4096) AS BIGINT) * 4096) FROM lat) AS ratio FROM liv")(
    lambda v: L.latest(v.rec).agg((F.sum("rb") / F.sum(F.ceil((F.col("plen") + 5) / 4096) * 4096)).alias("ratio"))
)
query("latency_p50_p99", "SELECT type_id, max(plen) FILTER (WHERE i = n // 2) AS p50, max(plen) FILTER (WHERE i = n * 99 // 100) AS p99 FROM (SELECT type_id, plen, row_number() OVER (PARTITION BY type_id ORDER BY plen, gen) - 1 AS i, count(*) OVER (PARTITION BY type_id) AS n FROM rec) GROUP BY type_id")(
    lambda v: X.nearest_rank(v.rec, "type_id", "plen", {"p50": (1, 2), "p99": (99, 100)})
)
query("dict_train_gate", "SELECT type_id, count(*) AS samples, CAST(sum(plen) AS BIGINT) AS bytes FROM rec GROUP BY type_id HAVING count(*) >= 100 AND sum(plen) >= 102400")(
    lambda v: v.rec.groupBy("type_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("plen").alias("bytes")).where((F.col("samples") >= 100) & (F.col("bytes") >= 102_400))
)

# --- conversion ------------------------------------------------------------------------------------------------------------

query(
    "region_name_parse",
    r""", names AS (SELECT DISTINCT 'r.' || rx || '.' || rz || '.mca' AS name FROM reg UNION ALL SELECT unnest(['r.1.mca', 'r.a.2.mca', 'r.1.2.mcr', 'x.1.2.mca', 'r.-1.-2.3.mca']))
        SELECT name, CAST(nullif(regexp_extract(name, '^r\.(-?[0-9]+)\.(-?[0-9]+)\.mca$', 1), '') AS INT) AS rx, CAST(nullif(regexp_extract(name, '^r\.(-?[0-9]+)\.(-?[0-9]+)\.mca$', 2), '') AS INT) AS rz FROM names""",
)(
    lambda v: C.parsed_names(
        L.region_project(v.rec).select(F.format_string("r.%d.%d.mca", "rx", "rz").alias("name")).distinct().unionByName(v.spark.range(1).select(F.explode(F.array(*(F.lit(n) for n in ("r.1.mca", "r.a.2.mca", "r.1.2.mcr", "x.1.2.mca", "r.-1.-2.3.mca")))).alias("name")))
    )
)
MARKS = "SELECT '.:' || type_name || ':r' || rx || '.' || rz AS marker FROM reg JOIN typ USING (type_id)"
query("progress_parse", f"SELECT DISTINCT marker FROM ({MARKS})")(
    lambda v: C.parsed_progress(_markers(v).select(F.col("marker").alias("value")).unionByName(v.spark.range(1).select(F.explode(F.array(F.lit(""), F.lit("junk"), F.lit(".:chunk:rx.1"), F.lit(".:tile:r1.1"))).alias("value"))))
)
query("resume_skip", f"SELECT DISTINCT marker FROM ({MARKS}) ANTI JOIN (SELECT '.:' || type_name || ':r' || rx || '.' || rz AS marker FROM hst, typ WHERE type_id < 2) USING (marker)")(
    lambda v: C.to_convert(_markers(v).distinct(), v.history_stable.where("stable").select("rx", "rz", F.explode(F.array(F.lit("chunk"), F.lit("entity"))).alias("kind")).select(C.marker(F.lit("."), F.col("kind"), F.col("rx"), F.col("rz")).alias("marker")))
)
query("convert_in", "SELECT rx, rz, type_id, count(*) AS records, CAST(sum(plen) AS BIGINT) AS bytes FROM lat WHERE type_id < 3 AND plen > 0 GROUP BY ALL")(
    lambda v: L.known_types(L.region_project(L.latest(v.rec))).where("plen > 0").groupBy("rx", "rz", "type_id").agg(F.count(F.lit(1)).alias("records"), F.sum("plen").alias("bytes"))
)
query("convert_out", "SELECT dir, rx, rz, x, z, gen, plen FROM cle JOIN typ USING (type_id) WHERE plen > 0")(lambda v: C.exported(v.rec).select("dir", "rx", "rz", "x", "z", "gen", "plen"))
query("export_order", "SELECT gen, row_number() OVER (PARTITION BY dir, rx, rz ORDER BY z, x) AS place FROM cle JOIN typ USING (type_id) WHERE plen > 0")(
    lambda v: C.exported(v.rec).select("gen", F.row_number().over(W.partitionBy("dir", "rx", "rz").orderBy("z", "x")).cast("bigint").alias("place"))
)
query(
    "mca_sector_plan",
    "SELECT gen, sectors, CAST(2 + coalesce(sum(sectors) OVER (PARTITION BY rx, rz, type_id ORDER BY z, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, sectors <= 255 AS fits FROM (SELECT *, CAST(ceil((plen * 37 + 5) / 4096) AS BIGINT) AS sectors FROM cle JOIN typ USING (type_id) WHERE plen > 0)",
)(lambda v: C.sector_plan(C.exported(v.rec).withColumn("plen", F.col("plen") * 37)).select("gen", *big("sectors", "start"), "fits"))
query(
    "convert_report",
    "SELECT count(DISTINCT (rx, rz, type_id)) FILTER (WHERE type_id < 3 AND plen > 0) AS regions, count(*) FILTER (WHERE type_id < 3 AND plen > 0) AS records, count(*) FILTER (WHERE type_id > 2) AS skipped, count(*) FILTER (WHERE type_id < 3 AND plen = 0) AS tombstones, count(*) FILTER (WHERE type_id < 3 AND plen > 0 AND substring(hex(encode(payload)), 1, 4) <> '1F8B') AS legacy FROM cle",
)(lambda v: C.report(v.rec))
query("legacy_raw", "SELECT gen, substring(hex(encode(payload)), 1, 4) <> '1F8B' AS legacy FROM rec")(lambda v: v.rec.select("gen", C.is_legacy(F.col("payload")).alias("legacy")))
query("export_merge", "SELECT e.x, e.z, e.type_id, CASE WHEN l.plen IS NULL THEN 'keep' WHEN l.plen = 0 THEN 'drop' ELSE 'replace' END AS action FROM (SELECT DISTINCT x + z AS x, z, type_id FROM rec) e LEFT JOIN lat l USING (x, z, type_id)")(
    lambda v: C.export_merge(v.rec.select((F.col("x") + F.col("z")).alias("x"), "z", "type_id").distinct(), L.latest(v.rec)).select(*K, "action")
)
query("read_through", "SELECT e.x, e.z, e.type_id, CASE WHEN l.gen IS NULL THEN 'miss' WHEN l.plen = 0 THEN 'deleted' ELSE 'hit' END AS state FROM (SELECT DISTINCT x, z + 1 AS z, type_id FROM rec) e LEFT JOIN lat l USING (x, z, type_id)")(
    lambda v: C.read_through(v.rec.select("x", (F.col("z") + 1).alias("z"), "type_id").distinct(), L.latest(v.rec)).select(*K, "state")
)


def _markers(v: Views) -> DataFrame:
    return L.with_type_names(L.region_project(v.rec)).select(C.marker(F.lit("."), F.col("type_name"), F.col("rx"), F.col("rz")).alias("marker"))


# --- scalar functions ------------------------------------------------------------------------------------------------------

query("comp_id_unpack", "SELECT gen, CAST(gen % 256 AS INT) AS comp_id, CAST(gen % 256 AS INT) & 15 AS codec, CAST(gen % 256 AS INT) >> 4 AS dict_slot FROM rec")(
    lambda v: v.rec.select("gen", (F.col("gen") % 256).cast("int").alias("comp_id")).select("gen", "comp_id", X.codec_id(F.col("comp_id")).alias("codec"), X.dict_slot(F.col("comp_id")).alias("dict_slot"))
)
query("codec_dispatch", "SELECT gen, CASE gen % 2 WHEN 0 THEN 'none' ELSE 'zstd' END AS codec FROM rec")(lambda v: v.rec.select("gen", X.codec_name((F.col("gen") % 2).cast("int")).alias("codec")))
query("varint_len", "SELECT gen, CASE WHEN plen < 128 THEN 1 WHEN plen < 16384 THEN 2 ELSE 3 END AS n FROM rec")(lambda v: v.rec.select("gen", X.varint_length(F.col("plen")).alias("n")))
query("human_bytes", "SELECT gen, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', floor(n / 1024 * 10 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f MiB', floor(n / 1048576 * 10 + 0.5) / 10) ELSE printf('%.1f GiB', floor(n / 1073741824 * 10 + 0.5) / 10) END AS shown FROM (SELECT gen, plen * gen AS n FROM rec)")(
    lambda v: v.rec.select("gen", X.human_bytes(F.col("plen") * F.col("gen")).alias("shown"))
)
query("cache_sim", None)(lambda v: X.simulated_cache(v.seg.select("gen", "seg", "rb"), 64 * SEGMENT))
query("codec_ratio", None)(lambda v: X.codec_ratios(v.rec))
