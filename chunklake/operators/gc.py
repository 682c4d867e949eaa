"""Garbage collection as plans: dead spans, punches, candidates, scores, budgeted selection, what a pass reclaims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunklake.operators.latest import with_liveness
from chunklake.operators.segments import triage, with_offsets
from chunklake.schema import ENVELOPE, dims

THRESHOLD, BUDGET, MIN_HOLE, PUNCH_PIECE = 0.6, 32 << 20, 64 << 10, 32 << 10


def dead_spans(df: DataFrame) -> DataFrame:
    """Maximal runs of dead records in each segment: seg, s, e, records. Touching runs are one."""
    d = dims(df)
    dead = with_liveness(with_offsets(df)).where(~F.col("live")).select(*d, "seg", F.col("offset").alias("s"), (F.col("offset") + F.col("rb")).alias("e"))
    order = W.partitionBy(*d, "seg").orderBy("s")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = dead.withColumn("opens", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)).withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*d, "seg", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("records")).drop("run")


def candidates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Segments whose dead share reaches the threshold."""
    t = triage(df)
    return t.withColumn("dead_ratio", F.col("dead_bytes") / F.greatest("total_bytes", F.lit(1))).where(F.col("dead_ratio") >= threshold)


def punches(df: DataFrame, min_hole: int = MIN_HOLE, threshold: float = THRESHOLD) -> DataFrame:
    """Payloads of dead records in spans of at least min_hole bytes, in segments that are due but not deleted as a whole."""
    d = dims(df)
    due = candidates(df, threshold).where((F.col("live") > 0) | (F.col("corrupt_latest") > 0)).select(*d, "seg")
    spans = dead_spans(df).where(F.col("e") - F.col("s") >= min_hole).join(due, [*d, "seg"], "left_semi").select(*d, "seg", "s", "e")
    dead = with_liveness(with_offsets(df)).where(~F.col("live")).select(*d, "seg", "gen", "offset", "plen")
    # a record's span is the one that begins last before it: spans and records in one order, no range join
    both = dead.select(*d, "seg", F.col("offset").alias("at"), F.lit(1).alias("kind"), "gen", "plen", F.lit(None).cast("bigint").alias("e")).unionByName(
        spans.select(*d, "seg", F.col("s").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("gen"), F.lit(None).cast("bigint").alias("plen"), "e")
    )
    order = W.partitionBy(*d, "seg").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    x = both.withColumn("span_end", F.last("e", ignorenulls=True).over(order)).where((F.col("kind") == 1) & (F.col("at") < F.col("span_end")))
    return x.select(*d, "seg", "gen", (F.col("at") + ENVELOPE).alias("offset"), F.col("plen").alias("length"))


def punch_chunks(punched: DataFrame, piece: int = PUNCH_PIECE) -> DataFrame:
    """Punches cut into pieces of at most ``piece`` bytes."""
    cut = punched.where(F.col("length") > 0).withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(piece).cast("bigint"))))
    return cut.select(*dims(punched), "seg", "gen", (F.col("offset") + F.col("at")).alias("offset"), F.least(F.lit(piece).cast("bigint"), F.col("length") - F.col("at")).alias("length"))


def acted(triaged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Triaged segments with dead_ratio and action: delete (nothing live, nothing corrupt that is latest), keep, compact (its dead payloads
    may be punched before), or punch only (a corrupt latest record must stay where it is)."""
    t = triaged.withColumn("dead_ratio", F.col("dead_bytes") / F.greatest("total_bytes", F.lit(1)))
    action = (
        F.when((F.col("live") == 0) & (F.col("corrupt_latest") == 0), "delete")
        .when((F.col("dead") == 0) | (F.col("dead_ratio") < threshold), "keep")
        .when(F.col("corrupt_latest") > 0, "punch")
        .otherwise("compact")
    )
    return t.withColumn("action", action)


def plan(df: DataFrame, threshold: float = THRESHOLD, min_hole: int = MIN_HOLE, piece: int = PUNCH_PIECE) -> DataFrame:
    """Each segment's action with what the punch step takes first: holes (pieces) and punched_bytes."""
    d = dims(df)
    holes = punch_chunks(punches(df, min_hole, threshold), piece).groupBy(*d, "seg").agg(F.count(F.lit(1)).alias("holes"), F.sum("length").alias("punched_bytes"))
    return acted(triage(df), threshold).join(holes, [*d, "seg"], "left").fillna(0, ["holes", "punched_bytes"])


def scored(planned: DataFrame, epoch: int | None = None) -> DataFrame:
    """Compaction candidates (dead bytes are left after the punch step) with their score: dead bytes per epoch of age. epoch: a column
    ``epoch`` if None."""
    now = F.col("epoch") if epoch is None else F.lit(epoch)
    age = F.greatest(now - F.col("created_epoch"), F.lit(1))
    return planned.where("action = 'compact' and dead_bytes > punched_bytes").withColumn("score", F.col("dead_bytes") / age)


def selected(candidates_: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Best score first, ties by segment; one that doesn't fit the budget is skipped and the next tried.

    Skipping depends on all before it, so the candidates of a dimension are folded in one task: a few numbers for each segment
    over the threshold, not records.
    """
    d = dims(candidates_)
    item = F.struct((-F.col("score")).alias("rank"), "seg", F.col("live_bytes").cast("bigint").alias("live_bytes"))
    one = candidates_.groupBy(*d).agg(F.array_sort(F.collect_list(item)).alias("items"))
    fold = f"""aggregate(items, named_struct('moved', 0L, 'out', cast(array() as array<bigint>)),
        (a, v) -> if(a.moved + v.live_bytes <= {budget}L, named_struct('moved', a.moved + v.live_bytes, 'out', concat(a.out, array(v.seg))), a), a -> a.out)"""
    return one.select(*d, F.explode(F.expr(fold)).alias("seg"))


def stats(planned: DataFrame, budget: int = BUDGET, epoch: int | None = None) -> DataFrame:
    """What a pass does with this plan: segments deleted and, within the budget, compacted; holes punched; records and bytes moved; bytes
    reclaimed: whole segments, punched payloads, and of a compacted segment what neither moved nor was punched."""
    d = dims(planned)
    chosen = selected(scored(planned, epoch), budget).select(*d, "seg", F.lit(True).alias("moves"))
    p = planned.join(chosen, [*d, "seg"], "left")
    total = lambda when, v: F.coalesce(F.sum(F.when(when, v)), F.lit(0))
    delete, due, moves = F.col("action") == "delete", F.col("action").isin("punch", "compact"), F.coalesce("moves", F.lit(False))
    net = F.col("total_bytes") - F.col("live_bytes") - F.col("punched_bytes")
    return p.agg(
        total(delete, F.lit(1)).alias("removed"),
        total(moves, F.lit(1)).alias("compacted"),
        total(due, F.col("holes")).alias("holes"),
        total(due, F.col("punched_bytes")).alias("punched_bytes"),
        total(moves, F.col("live")).alias("records_moved"),
        total(moves, F.col("live_bytes")).alias("moved_bytes"),
        (total(delete, F.col("total_bytes")) + total(due, F.col("punched_bytes")) + total(moves, net)).alias("reclaimed_bytes"),
    )


def compacted(df: DataFrame, segments: DataFrame, new_segment: int) -> DataFrame:
    """df after compaction of ``segments`` (seg): their live rows move as they are to new_segment, dead ones vanish."""
    d = dims(df)
    s = segments.select(*d, "seg", F.lit(True).alias("moves"))
    x = with_liveness(df).join(s, [*d, "seg"], "left").where(F.col("moves").isNull() | F.col("live"))
    return x.withColumn("seg", F.when(F.col("moves"), F.lit(new_segment).cast("bigint")).otherwise(F.col("seg"))).drop("moves", "live")


def advanced_buckets(segments: DataFrame, flushes: int) -> DataFrame:
    """Young segments become active once two flushes have passed; no segment becomes stable."""
    return segments.withColumn("bucket", F.when((F.col("bucket") == "young") & (F.lit(flushes) >= 2), "active").otherwise(F.col("bucket")))
