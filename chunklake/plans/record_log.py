"""The record log that the queries run on, derived from ``events``: as DataFrames, and as SQL common table expressions.

One row is one write of a key; versions (gen) ascend in time; one minute is one epoch; some payloads are tombstones, some rows corrupt,
some types unknown.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.operators import latest as L
from chunklake.operators import segments as S
from chunklake.operators import tier as T

SEGMENT = 2048
PERSISTED_GEN = 1


def record_log(events: DataFrame) -> DataFrame:
    epoch = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 60_000_000)
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    payload = F.when(F.col("event_id") % 53 == 0, F.lit("")).otherwise(F.expr("repeat(props, cast(1 + event_id % 40 as int))"))
    x = events.select(
        F.col("event_id").alias("gen"),
        (F.col("user_id").cast("int") - 40).alias("x"),
        ((F.col("event_id") % 8).cast("int") - 4).alias("z"),
        kind.alias("type_id"),
        epoch.cast("int").alias("epoch_ts"),
        payload.alias("payload"),
        (F.col("event_id") % 97 == 0).alias("corrupt"),
    )
    return x.withColumn("plen", F.octet_length("payload").cast("bigint")).withColumn("rb", F.col("plen") + 40)


@dataclass
class Views:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def rec(self) -> DataFrame:
        return record_log(self.spark.read.parquet(f"{self.sf_dir}/events.parquet"))

    @cached_property
    def epoch(self) -> DataFrame:
        """One row: the epoch after the log's last."""
        return self.rec.agg((F.max("epoch_ts") + 1).alias("epoch"))

    @cached_property
    def head(self) -> DataFrame:
        """One row: the highest version and the current epoch."""
        return self.rec.agg(F.max("gen").alias("base"), (F.max("epoch_ts") + 1).alias("epoch"))

    @cached_property
    def seg(self) -> DataFrame:
        """The log in segments of SEGMENT bytes by plain packing."""
        return S.floor_packed(self.rec, SEGMENT)

    @cached_property
    def cut(self) -> DataFrame:
        """One row: the version that ends the history of the hot and cold scenario."""
        return self.rec.agg(F.floor(F.max("gen") * 85 / 100).alias("cut"))

    @cached_property
    def history(self) -> DataFrame:
        return self.rec.crossJoin(F.broadcast(self.cut)).where("gen <= cut").drop("cut")

    @cached_property
    def recent(self) -> DataFrame:
        return self.rec.crossJoin(F.broadcast(self.cut)).where("gen > cut").drop("cut")

    @cached_property
    def history_stable(self) -> DataFrame:
        return T.stable_regions(self.history, self.history.agg((F.max("epoch_ts") + 1).alias("epoch")))

    @cached_property
    def cold(self) -> DataFrame:
        return T.cold_slots(self.history, self.history_stable)

    @cached_property
    def hot(self) -> DataFrame:
        """Latest versions outside the cold regions of the history, and all later ones."""
        stable = self.history_stable.where("stable").select("rx", "rz")
        old = L.region_project(self.history).join(stable, ["rx", "rz"], "left_anti").select(*self.rec.columns)
        return L.latest(old.unionByName(self.recent))

    @cached_property
    def invalid(self) -> DataFrame:
        return T.invalidated(self.cold, self.recent)


#: The same views for DuckDB, in the order in which they build on each other.
CTES = {
    "rec0": """SELECT event_id AS gen, CAST(user_id AS INT) - 40 AS x, CAST(event_id % 8 AS INT) - 4 AS z,
        CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS type_id,
        CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS INT) AS epoch_ts,
        CASE WHEN event_id % 53 = 0 THEN '' ELSE repeat(props, CAST(1 + event_id % 40 AS INT)) END AS payload,
        event_id % 97 = 0 AS corrupt FROM events""",
    "rec": "SELECT *, octet_length(encode(payload)) AS plen, 40 + octet_length(encode(payload)) AS rb FROM rec0",
    "reg": "SELECT *, x >> 5 AS rx, z >> 5 AS rz, x & 31 AS x_rel, z & 31 AS z_rel FROM rec",
    "liv": "SELECT *, gen = max(gen) OVER (PARTITION BY x, z, type_id) AS live FROM reg",
    "lat": "SELECT * FROM liv WHERE live",
    "seg": f"SELECT *, CAST(floor((sum(rb) OVER (ORDER BY gen) - rb) / {SEGMENT}) AS BIGINT) AS seg FROM liv",
    "ofs": "SELECT *, CAST(16 + coalesce(sum(rb) OVER (PARTITION BY seg ORDER BY gen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM seg",
    "tri": """SELECT seg, count(*) FILTER (WHERE live AND NOT corrupt) AS live, count(*) FILTER (WHERE live AND corrupt) AS corrupt_latest,
        count(*) FILTER (WHERE NOT live) AS dead, CAST(coalesce(sum(rb) FILTER (WHERE NOT live), 0) AS BIGINT) AS dead_bytes,
        CAST(coalesce(sum(rb) FILTER (WHERE live), 0) AS BIGINT) AS live_bytes, CAST(sum(rb) AS BIGINT) AS total_bytes,
        min(epoch_ts) AS created_epoch FROM seg GROUP BY seg""",
    "pln": """SELECT *, dead_bytes / greatest(total_bytes, 1) AS dead_ratio, CASE WHEN live = 0 AND corrupt_latest = 0 THEN 'delete'
        WHEN dead = 0 OR dead_bytes / greatest(total_bytes, 1) < 0.6 THEN 'keep' WHEN corrupt_latest > 0 THEN 'punch' ELSE 'compact' END AS action FROM tri""",
    "sc": """SELECT *, dead_bytes / greatest((SELECT max(epoch_ts) + 1 FROM rec) - created_epoch, 1) AS score FROM pln WHERE action = 'compact'""",
    "dd": "SELECT seg, off AS s, off + rb AS e FROM ofs WHERE NOT live",
    "br": "SELECT *, CASE WHEN s > max(e) OVER w OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM dd WINDOW w AS (PARTITION BY seg ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "rn": "SELECT *, sum(opens) OVER (PARTITION BY seg ORDER BY s) AS run FROM br",
    "spn": "SELECT seg, min(s) AS s, max(e) AS e, count(*) AS records FROM rn GROUP BY seg, run",
    "cut": "SELECT max(gen) * 85 // 100 AS cut FROM rec",
    "his": "SELECT r.* FROM reg r, cut WHERE gen <= cut",
    "cur": "SELECT r.* FROM reg r, cut WHERE gen > cut",
    "hla": "SELECT * FROM (SELECT *, gen = max(gen) OVER (PARTITION BY x, z, type_id) AS live FROM his) WHERE live",
    "hst": "SELECT rx, rz FROM hla GROUP BY rx, rz HAVING max(epoch_ts) + 30 <= (SELECT max(epoch_ts) + 1 FROM his)",
    "cold": "SELECT h.* FROM hla h SEMI JOIN hst USING (rx, rz)",
    "hot": "SELECT * FROM (SELECT *, gen = max(gen) OVER (PARTITION BY x, z, type_id) AS top FROM (SELECT * EXCLUDE (live) FROM (SELECT *, true AS live FROM his h ANTI JOIN hst USING (rx, rz)) UNION ALL SELECT * FROM cur)) WHERE top",
    "inv": "SELECT DISTINCT c.x, c.z, c.type_id, c.rx, c.rz FROM cold c SEMI JOIN cur USING (x, z, type_id)",
    "rat": """SELECT c.rx, c.rz, count(*) AS total_slots, count(i.x) AS invalid_slots, count(i.x) / count(*) AS ratio
        FROM cold c LEFT JOIN inv i ON c.x = i.x AND c.z = i.z AND c.type_id = i.type_id GROUP BY c.rx, c.rz""",
    "chk": "SELECT c.*, unnest(range(0, greatest(1, CAST(ceil(plen / 32) AS BIGINT)))) AS i FROM cold c",
    "sfe": "SELECT gen, min(CASE WHEN plen = 0 THEN '' ELSE md5(substring(payload, CAST(i * 32 + 1 AS BIGINT), 32)) END) AS min_h, max(CASE WHEN plen = 0 THEN '' ELSE md5(substring(payload, CAST(i * 32 + 1 AS BIGINT), 32)) END) AS max_h FROM chk GROUP BY gen",
    "lay0": "SELECT c.*, min_h, max_h, row_number() OVER (PARTITION BY rx, rz ORDER BY min_h, max_h, x_rel, z_rel, type_id) - 1 AS rn FROM cold c JOIN sfe USING (gen)",
    "lay": "SELECT *, rn // 64 AS block, rn % 64 AS in_block FROM lay0",
    "blk0": "SELECT rx, rz, block, count(*) AS records, CAST(sum(rb) AS BIGINT) AS bytes FROM lay GROUP BY ALL",
    "blk": "SELECT *, CAST(20 + coalesce(sum(bytes) OVER (PARTITION BY rx, rz ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset FROM blk0",
    "typ": "SELECT * FROM (VALUES (0, 'region', 'chunk'), (1, 'entities', 'entity'), (2, 'poi', 'poi')) t(type_id, dir, type_name)",
    "cle": "SELECT * FROM (SELECT *, gen = max(gen) OVER (PARTITION BY x, z, type_id) AS top FROM reg WHERE NOT corrupt) WHERE top",
}


def sql(body: str) -> str:
    """A query over the views."""
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in CTES.items()) + " " + body
