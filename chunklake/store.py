"""A store: immutable Parquet snapshots of a record log, and one pointer file that says which of them count.

Every change writes new files first and then replaces the pointer; a job that dies leaves the snapshot before it. Writers hold a lock
that the operating system releases when they end, however they end. What a reader sees is one pointer's snapshot, so a region is
never half promoted or demoted; files that a pointer no longer names stay for KEPT_COMMITS more commits, for readers that began before.

Each part carries a note (what it is, which parts it replaces, the numbers of its commit). Opening a store reconciles the pointer
with the parts that are there: a whole part that a crash kept out of the pointer is taken in, an incomplete one deleted, one that
is gone is dropped, and version numbers go on after the highest. Without any pointer the store is rebuilt from its parts;
a pointer that can't be read, nor its copy, is an error, for then nothing says which parts count.

Rows lie in order of their region and key, so that a read of a key or a region skips what is elsewhere.

Rows visible as hot are those newer than their region's promotion; a cold slot is invalid when a hot row has its key: both
follow from one snapshot, so an overwrite of a cold key and its slot's invalidation can't come apart.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.config import Config
from chunklake.functions.codecs import compressed, decode, decompressed, payload_hash
from chunklake.operators import archive as A
from chunklake.operators import gc as G
from chunklake.operators import latest as L
from chunklake.operators import tier as T
from chunklake.operators import verify as V

ROWS = "dim string, x int, z int, type_id int, gen bigint, epoch_ts bigint, record_ver int, comp_id int, payload binary, plen bigint, rb bigint, payload_hash bigint, corrupt boolean"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
K = ["dim", "x", "z", "type_id"]
R = ["dim", "rx", "rz"]
EMPTY = {"version": 0, "epoch": 0, "flushes": 0, "maintained": 0, "next_gen": 1, "hot": [], "cold": [], "gone": [], "batch": -1, "trash": []}
KINDS = ("hot", "cold", "gone")
NOTE = "_part.json"
KEPT_COMMITS = 2


class StoreError(RuntimeError):
    """The store can't be opened or changed."""


@dataclass
class GcStats:
    removed: int
    compacted: int
    punched: int
    reclaimed_bytes: int
    moved_bytes: int


@dataclass
class TierStats:
    promoted: int
    demoted: int
    cold_bytes: int


class Store:
    def __init__(self, spark: SparkSession, root: str, config: Config) -> None:
        self.spark, self.root, self.config = spark, Path(root), config
        self._lock_file: int | None = None

    # --- life ------------------------------------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: Config | None = None) -> Store:
        """Opens, recovers or creates a store and locks it against other writers. root: a folder that driver and executors share."""
        s = cls(spark, root, config or Config(enabled=True))
        s.root.mkdir(parents=True, exist_ok=True)
        s._lock()
        try:
            s._reconcile(s.state() if any(p.exists() for p in s._pointers()) else dict(EMPTY))
        except BaseException:
            s.close()
            raise
        return s

    @classmethod
    def rebuild(cls, spark: SparkSession, root: str, config: Config | None = None) -> Store:
        """A pointer from the parts alone, whatever the pointer says."""
        s = cls(spark, root, config or Config(enabled=True))
        s._lock()
        try:
            s._reconcile(dict(EMPTY))
        except BaseException:
            s.close()
            raise
        return s

    def _note(self, part: str) -> dict | None:
        """What a part says of itself; None if it was not finished."""
        try:
            return json.loads((self.root / part / NOTE).read_text())
        except (OSError, ValueError):
            return None

    def _reconcile(self, state: dict) -> None:
        """Commits the state with the parts that are there; parts of a version that the state has gone past were replaced by it."""
        state = dict(EMPTY) | state
        there = {p.name: self._note(p.name) for kind in KINDS for p in self.root.glob(f"{kind}-*")}
        named = {p for kind in KINDS for p in state[kind]}
        old = {p for p, _ in state["trash"]}
        claimed = sorted((n["version"], p) for p, n in there.items() if n and p not in named and p not in old and n["version"] > state["version"])
        after = state | {kind: [p for p in state[kind] if there.get(p)] for kind in KINDS}
        for _, p in claimed:
            note = there[p]
            for kind in KINDS:
                after[kind] = [q for q in after[kind] if q not in note["replaces"]]
            after[p.split("-")[0]].append(p)
            for c in ("epoch", "flushes", "batch"):
                after[c] = max(after[c], note[c])
        replaced = {q for _, p in claimed for q in there[p]["replaces"]}
        for kind in KINDS:
            after[kind] = [p for p in after[kind] if p not in replaced]
        if claimed or state["version"] == 0:
            top = self._rows(after["hot"]).select("gen").unionByName(self._rows(after["cold"]).select("gen")).agg(F.max("gen")).first()[0]
            after["next_gen"] = max(after["next_gen"], (top or 0) + 1, *(there[p]["next_gen"] for _, p in claimed))
        if after != state or state["version"] == 0:
            after["version"] = max([after["version"], *(there[p]["version"] for _, p in claimed)])
            after = self._commit(after)
        keep = {p for kind in KINDS for p in after[kind]} | {p for p, _ in after["trash"]}
        self._delete([p for p in there if p not in keep] + [p.name for p in self.root.glob("stage-*")])

    def _lock(self) -> None:
        f = os.open(self.root / "lock", os.O_CREAT | os.O_RDWR)
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            os.close(f)
            raise StoreError(f"{self.root} is locked by {(self.root / 'lock').read_text()!r}") from e
        os.ftruncate(f, 0)
        os.write(f, f"pid {os.getpid()}".encode())
        self._lock_file = f

    def close(self) -> None:
        if self._lock_file is not None:
            os.close(self._lock_file)  # releases the lock
            self._lock_file = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    # --- snapshots ---------------------------------------------------------------------------------------------------------

    @property
    def _pointer(self) -> Path:
        return self.root / "pointer.json"

    def _pointers(self) -> tuple[Path, Path]:
        return self._pointer, self._pointer.with_suffix(".bak")

    def state(self) -> dict:
        for p in self._pointers():
            try:
                return dict(EMPTY) | json.loads(p.read_text())
            except (OSError, ValueError):
                continue
        raise StoreError(f"{self.root}: neither the pointer nor its copy can be read; Store.rebuild takes the parts alone")

    def _commit(self, state: dict) -> dict:
        if self._lock_file is None:
            raise StoreError("the store is closed")
        state = state | {"version": state["version"] + 1}
        gone = [p for p, v in state["trash"] if v + KEPT_COMMITS < state["version"]]
        state["trash"] = [[p, v] for p, v in state["trash"] if p not in gone]
        new = self._pointer.with_suffix(".tmp")
        with new.open("w") as f:
            json.dump(state, f)
            f.flush()
            os.fsync(f.fileno())
        if self._pointer.exists():
            shutil.copyfile(self._pointer, self._pointer.with_suffix(".bak"))
        os.replace(new, self._pointer)
        self._sync(self.root)
        self._delete(gone)
        return state

    @staticmethod
    def _sync(path: Path) -> None:
        f = os.open(path, os.O_RDONLY)
        try:
            os.fsync(f)
        finally:
            os.close(f)

    def _rows(self, parts: list[str], schema: str = ROWS) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(str(self.root / p) for p in parts))

    def _put(self, df: DataFrame, kind: str, state: dict, replaces: list[str] = [], durable: bool = False) -> str:  # noqa: B006
        """Writes a part and then its note, which makes it whole. state: what the commit that names it will say."""
        name = f"{kind}-{uuid.uuid4().hex}"
        codec = "zstd" if kind != "cold" or self.config.cold_compression else "none"
        df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", self.config.cold_level if kind == "cold" else self.config.hot_level).parquet(str(self.root / name))
        if durable:
            for p in [*(self.root / name).iterdir(), self.root / name]:
                self._sync(p)
        note = {c: state[c] for c in ("epoch", "flushes", "batch", "next_gen")} | {"version": state["version"] + 1, "replaces": replaces}
        with (self.root / name / NOTE).open("w") as f:
            json.dump(note, f)
            f.flush()
            os.fsync(f.fileno())
        return name

    def _delete(self, parts: list[str]) -> None:
        for p in parts:
            shutil.rmtree(self.root / p, ignore_errors=True)

    @staticmethod
    def _without(state: dict, parts: list[str]) -> dict:
        """state without these parts, whose files stay for a while."""
        return {"trash": [*state["trash"], *([p, state["version"] + 1] for p in parts)]}

    @staticmethod
    def _clustered(rows: DataFrame) -> DataFrame:
        order = ["dim", F.shiftright("x", 5), F.shiftright("z", 5), "x", "z", "type_id"]
        return rows.repartitionByRange(*order).sortWithinPartitions(*order, "gen")

    # --- views -------------------------------------------------------------------------------------------------------------

    def cold(self) -> DataFrame:
        """Cold slots with their region and the version up to which the region was promoted."""
        s = self.state()
        x = self._rows(s["cold"], ROWS + ", rx int, rz int, x_rel int, z_rel int, block bigint, upto bigint")
        return x.join(self._rows(s["gone"], "dim string, rx int, rz int, upto bigint"), [*R, "upto"], "left_anti")

    def hot(self) -> DataFrame:
        """Rows newer than the promotion of their region."""
        regions = self.cold().groupBy(*R).agg(F.max("upto").alias("upto"))
        x = L.region_project(self._rows(self.state()["hot"])).join(regions, R, "left")
        return x.where(F.col("upto").isNull() | (F.col("gen") > F.col("upto"))).drop("rx", "rz", "x_rel", "z_rel", "upto")

    def invalid(self) -> DataFrame:
        return T.invalidated(self.cold(), self.hot())

    def latest(self) -> DataFrame:
        """Each key's latest row, hot before cold; tombstones included."""
        hot = L.latest(self.hot())
        cold = self.cold().select(*hot.columns).join(hot.select(*K), K, "left_anti")
        return hot.unionByName(cold)

    def read(self, x: int, z: int, type_id: int, dim: str = ".") -> tuple[str, bytes | None]:
        """hit with the plain payload, deleted, or miss (also where the latest version can't be read).

        Only the key's rows are taken from the hot parts and only its region's from the cold ones; both filters reach the files.
        """
        key = (F.col("dim") == dim) & (F.col("x") == x) & (F.col("z") == z) & (F.col("type_id") == type_id)
        region = (F.col("dim") == dim) & (F.col("rx") == x >> 5) & (F.col("rz") == z >> 5)
        columns = ["gen", "payload", "comp_id", "plen", "corrupt"]
        cold = self.cold().where(region)
        upto = cold.agg(F.max("upto")).first()[0]
        hot = self._rows(self.state()["hot"]).where(key if upto is None else key & (F.col("gen") > upto))
        own = hot.select(*columns).orderBy(F.desc("gen")).limit(1).collect() or cold.where(key).select(*columns).orderBy(F.desc("gen")).limit(1).collect()
        if not own or own[0].corrupt:
            return "miss", None
        return ("deleted", None) if own[0].plen == 0 else ("hit", decode(bytes(own[0].payload), own[0].comp_id))

    def verify(self) -> DataFrame:
        return V.report(self.hot().unionByName(self.cold().select(*self.hot().columns)))

    def stats(self) -> DataFrame:
        hot = L.with_liveness(self.hot())
        a = hot.agg(F.coalesce(F.sum(F.when(F.col("live"), F.col("rb"))), F.lit(0)).alias("live_bytes"), F.coalesce(F.sum("rb"), F.lit(0)).alias("total_bytes"), F.count(F.lit(1)).alias("records"))
        c = self.cold().agg(F.count_distinct(*R).alias("archives"), F.coalesce(F.sum("rb"), F.lit(0)).alias("archive_bytes"))
        return a.crossJoin(c).withColumn("segments", F.lit(len(self.state()["hot"])))

    # --- changes -------------------------------------------------------------------------------------------------------------

    def write(self, rows: DataFrame, order: str = "order", batch: int | None = None, flush: bool = False, durable: bool = False, marks: list[str] | None = None) -> int:
        """Appends rows (x, z, type_id, payload, and dim, ``order`` if there are). They get the next version numbers in the order of
        ``order``, or in the order in which Spark reads them. Returns how many. A batch number already seen writes nothing. flush:
        the same commit ends the epoch. durable: the rows' files are on disk before the commit. marks: kept in the commit."""
        s = self.state()
        if batch is not None and batch <= s["batch"]:
            return 0
        x = rows.withColumn("dim", F.col("dim") if "dim" in rows.columns else F.lit(".")).withColumn("__order", F.col(order).cast("bigint") if order in rows.columns else F.monotonically_increasing_id())
        staged = f"stage-{uuid.uuid4().hex}"
        x.select("dim", "x", "z", "type_id", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"), "__order").write.parquet(str(self.root / staged))
        x = self._rows([staged], "dim string, x int, z int, type_id int, payload binary, __order bigint")
        n = x.count()
        after = s | {"next_gen": s["next_gen"] + n, "batch": s["batch"] if batch is None else batch}
        if marks is not None:
            after["marks"] = marks
        if flush:
            after |= {"epoch": s["epoch"] + 1, "flushes": s["flushes"] + 1}
        if n:
            comp = 1 if self.config.hot_compression else 0
            x = L.assigned(x, s["next_gen"] - 1, ["__order", *K]).select(*K, F.col("new_gen").cast("bigint").alias("gen"), "payload")
            packed = F.when(F.octet_length("payload") == 0, F.col("payload")).otherwise(compressed("payload", self.config.hot_level)) if comp else F.col("payload")
            x = x.withColumn("payload", packed).withColumn("payload_hash", payload_hash("payload")).withColumn("plen", F.octet_length("payload").cast("bigint"))
            x = x.select(*K, "gen", F.lit(s["epoch"]).cast("bigint").alias("epoch_ts"), F.lit(1).alias("record_ver"), F.lit(comp).alias("comp_id"), "payload", "plen", (F.col("plen") + 40).alias("rb"), "payload_hash", F.lit(False).alias("corrupt"))
            after["hot"] = [*s["hot"], self._put(self._clustered(x), "hot", after, durable=durable)]
        self._commit(after)
        self._delete([staged])
        return n

    write_batch = write

    def flush(self) -> int:
        s = self.state()
        return self._commit(s | {"epoch": s["epoch"] + 1, "flushes": s["flushes"] + 1})["epoch"]

    def gc(self) -> GcStats:
        """One pass; each part of the hot log is a segment. Parts without a live row go as a whole. Of parts with a dead share of the
        threshold or more, those with the best score within the budget are compacted: their live rows move into one new part. A
        due part that isn't moved (the budget, or a corrupt latest row, which stays where it is) has its dead payloads
        emptied if they are gc.min-hole-bytes or more."""
        s = self.state()
        none = GcStats(0, 0, 0, 0, 0)
        if not self.config.gc_enabled or not s["hot"]:
            return none
        part = F.regexp_extract(F.col("_metadata.file_path"), r"/(hot-[0-9a-f]+)/[^/]*$", 1)
        raw = self.spark.read.schema(ROWS).parquet(*(str(self.root / p) for p in s["hot"])).select(*COLUMNS, part.alias("seg"))
        slim = raw.select(*K, "gen", "rb", "plen", "epoch_ts", "corrupt", "seg")
        # live: the highest version of its key among the rows that no promotion hides
        seen = self.hot().select(*K, "gen")
        live = seen.groupBy(*K).agg(F.max("gen").alias("gen")).select("gen", F.lit(True).alias("live_row"))
        is_live = F.coalesce("live_row", F.lit(False))
        t = slim.join(live, "gen", "left").groupBy("seg").agg(
            F.count_if(is_live & ~F.col("corrupt")).alias("live"),
            F.count_if(is_live & F.col("corrupt")).alias("corrupt_latest"),
            F.count_if(~is_live).alias("dead"),
            F.sum(F.when(is_live, 0).otherwise(F.col("rb"))).alias("dead_bytes"),
            F.sum(F.when(is_live, 0).otherwise(F.col("plen"))).alias("dead_payload"),
            F.sum(F.when(is_live, F.col("rb")).otherwise(0)).alias("live_bytes"),
            F.sum("rb").alias("total_bytes"),
            F.min("epoch_ts").alias("created_epoch"),
        )
        table = {r.seg: r for r in G.acted(t, self.config.gc_threshold).collect()}  # one row for each part
        gone = [k for k, r in table.items() if r.action == "delete"]
        due = [k for k, r in table.items() if r.action in ("compact", "punch")]
        chosen, moved = [], 0
        for k in sorted((k for k in due if table[k].action == "compact"), key=lambda k: (-table[k].dead_bytes / max(s["epoch"] - table[k].created_epoch, 1), k)):
            if moved + table[k].live_bytes <= self.config.gc_budget:
                chosen.append(k)
                moved += table[k].live_bytes
        punched = [k for k in due if k not in chosen and table[k].dead_payload >= max(1, self.config.gc_min_hole)]
        if not gone and not chosen and not punched:
            return none
        names = lambda parts: self.spark.createDataFrame([(p,) for p in parts], "seg string")
        new = []
        if chosen:
            rows = raw.join(names(chosen), "seg", "left_semi").join(live, "gen", "left_semi").select(*COLUMNS)
            new.append(self._put(self._clustered(rows), "hot", s, replaces=chosen))
        for k in punched:  # a part each: what the note of a part replaces must be in it
            emptied = raw.where(F.col("seg") == k).join(live, "gen", "left").withColumn("hole", F.col("live_row").isNull() & (F.col("plen") > 0))
            columns = {"payload": F.when(~F.col("hole"), F.col("payload")).otherwise(F.lit(b"")), "plen": F.when(F.col("hole"), 0).otherwise(F.col("plen")), "corrupt": F.col("corrupt") | F.col("hole")}
            emptied = emptied.withColumns(columns).withColumn("rb", F.col("plen") + 40)
            new.append(self._put(self._clustered(emptied.select(*COLUMNS)), "hot", s, replaces=[k]))
        out = [*gone, *chosen, *punched]
        self._commit(s | {"hot": [*(p for p in s["hot"] if p not in out), *new]} | self._without(s, out))
        reclaimed = sum(table[k].total_bytes for k in gone) + sum(table[k].dead_bytes for k in chosen) + sum(table[k].dead_payload for k in punched)
        return GcStats(len(gone), len(chosen), len(punched), reclaimed, moved)

    def tier(self) -> TierStats:
        """Demotes cold regions with too many invalid slots, then promotes regions not written for long (if the cold tier is on)."""
        s = self.state()
        cold, invalid = self.cold(), self.invalid()
        out = T.demote_candidates(cold, invalid, self.config.demote_ratio).select(*R).collect() if s["cold"] else []
        if out:
            head = self.spark.range(1).select(F.lit(s["next_gen"] - 1).alias("base"), F.lit(s["epoch"]).cast("bigint").alias("epoch"))
            back = T.demote_writeback(cold, invalid, head, self.config.demote_ratio)
            part = self._put(self._clustered(back.drop("gen").withColumn("gen", F.col("new_gen").cast("bigint")).select(*COLUMNS)), "hot", s)
            n = self._rows([part]).count()
            gone = self.spark.createDataFrame([(r.dim, r.rx, r.rz) for r in out], "dim string, rx int, rz int").join(cold.select(*R, "upto").distinct(), R)
            # the regions' newer hot rows count again from here on, for no promotion hides them
            self._commit(s | {"hot": [*s["hot"], part], "gone": [*s["gone"], self._put(gone.select(*R, "upto"), "gone", s)], "next_gen": s["next_gen"] + n})
            s = self.state()
        promoted = 0
        if self.config.cold_enabled:
            hot = self.hot()
            stable = T.stable_regions(hot, self.spark.range(1).select(F.lit(s["epoch"]).alias("epoch")), self.config.stable_flushes)
            fresh = stable.join(self.cold().select(*R).distinct(), R, "left_anti")
            rows = T.promote_plan(hot, fresh).withColumn("upto", F.lit(s["next_gen"] - 1).cast("bigint"))
            # plain payloads in the order of their content: the file's own compression works on pages of similar records, not on each alone
            plain = decompressed("payload", F.when(F.col("plen") == 0, F.lit(0)).otherwise(F.col("comp_id")))
            rows = rows.withColumn("payload", plain).withColumns({"comp_id": F.lit(0), "plen": F.octet_length("payload").cast("bigint"), "payload_hash": payload_hash("payload")})
            rows = rows.withColumn("rb", F.col("plen") + 40)
            laid = A.layout(rows).select("gen", "rn", "block")
            rows = rows.join(laid, "gen").repartitionByRange(*R, "block").sortWithinPartitions(*R, "rn")
            part = self._put(rows.select(*COLUMNS, "rx", "rz", "x_rel", "z_rel", "block", "upto"), "cold", s)
            promoted = self.spark.read.parquet(str(self.root / part)).select(*R).distinct().count()
            if promoted:
                self._commit(s | {"cold": [*s["cold"], part]})
            else:
                self._delete([part])
        return TierStats(promoted, len(out), self.cold().agg(F.coalesce(F.sum("rb"), F.lit(0))).first()[0])

    def maintain(self) -> None:
        """What a service does now and then: collection, flush, tiering."""
        self.gc()
        self.flush()
        self.tier()
        s = self.state()
        self._commit(s | {"maintained": s["flushes"]})

    def compact(self, most: int = 16) -> int:
        """Maintenance until nothing changes; returns the number of passes."""
        for n in range(1, most + 1):
            g, t = self.gc(), self.tier()
            if not (g.removed or g.compacted or g.punched or t.promoted or t.demoted):
                return n
        return most
