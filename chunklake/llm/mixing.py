"""Mixing sources to target weights by Pareto order sampling.

1. Each source gets a target in words: its weight's share of the total, at most ``max_repeats`` times its size; the
   excess goes to the other sources by weight (water filling over one row per source).
2. Every document of a source is taken ``floor(target / size)`` times: the certain whole copies.
3. The remaining words are a fixed-size Pareto sample. A document's inclusion probability is ``min(1, k * weight)``,
   its weight rising with its length (``s / (s + half_weight)``, so that fragments are repeated less), with k set per
   source so that the expected words equal the remainder. Documents are ranked by random odds over inclusion odds,
   ``(u / (1 - u)) / (p / (1 - p))``, and the sample is the head of that ranking whose words come nearest the remainder.

The head is found without sorting a source: the rank value maps to 4096 cells of 4096 cells; two histograms of words
(one row per source and cell) give the cell that ends the sample. So no task ever holds a source, however hot, and the
documents' texts are read once per pass and never shuffled. Memory: one row per source and length level or cell.

Cases: null text counts 0 words and is never short of its copies; a null source is a source of its own, last in order;
rows equal in id, source and size rank alike and are taken alike; an empty table gives an empty result; other columns,
whatever their names, are not read. The random numbers are hashes, so that a rerun takes the same documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunklake.llm.common import unsigned_unit, word_count, written

CELLS = 4096
LEVELS_PER_OCTAVE = 4


def slim(docs: DataFrame, seed: int = 0, *others: str) -> DataFrame:
    """doc_id, source, size, level and u of each document, and other columns."""
    # a projection of its own: what uses the size below does not count the words again
    x = docs.select(*others, "doc_id", "source", word_count(F.col("text")).alias("size"))
    level = F.floor(F.log2(F.greatest("size", F.lit(1))) * LEVELS_PER_OCTAVE).cast("int").alias("level")
    return x.select(*others, "doc_id", "source", "size", level, unsigned_unit(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source").isNull(), F.col("source"), F.col("size"))).alias("u"))


def source_targets(sizes: DataFrame, weights: Sequence[float] | Mapping[str, float], max_repeats: int, total: int | None) -> DataFrame:
    """One row per source from (source, size): source, source_size, target, whole copies and remaining words.

    The windows without partition are over one row per source.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    if isinstance(weights, Mapping):
        weight = F.coalesce(*(F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in weights.items()), F.lit(1.0))
    else:
        weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    everything = W.partitionBy()
    goal = F.lit(float(total)) if total is not None else F.sum("source_size").over(everything).cast("double")
    ratio = W.orderBy("ratio", "weight", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    filled = (
        per.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
        .withColumns({"goal": goal, "ratio": F.col("cap") / F.col("weight"), "all_weight": F.sum("weight").over(everything)})
        .withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(ratio), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(ratio), F.lit(0.0))))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.col("level"))).over(everything))
    )
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    open_goal = F.col("goal") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * open_goal / open_weight)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(F.lit(0)).cast("int")
    return filled.withColumn("target", target).withColumn("whole", whole).select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def inclusion(levels: DataFrame, targets: DataFrame, half_weight: float) -> DataFrame:
    """One row per source and length level: the probability p of one more copy.

    levels: source, level, words. p = min(1, k * weight) with sum(words * p) = rest.
    """
    s = F.pow(F.lit(2.0), F.col("level") / LEVELS_PER_OCTAVE)
    before = W.partitionBy("source").orderBy(F.col("w").desc()).rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("source")
    x = levels.alias("l").join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("l.source", "level", "words", "source_size", "target", "whole", "rest", (s / (s + half_weight)).alias("w"))
    weighed = F.col("w") * F.col("words")
    open_weight = F.sum(weighed).over(W.partitionBy("source").orderBy("w").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("k", (F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))) / F.nullif(open_weight, F.lit(0.0)))
    x = x.withColumn("certain", F.coalesce(F.col("k") * F.col("w") >= 1, F.lit(False)))
    k = F.max(F.when(~F.col("certain"), F.col("k"))).over(own)
    return x.withColumn("p", F.when(F.col("certain"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(k * F.col("w"), F.lit(0.0)))))).select("source", "level", "source_size", "target", "whole", "rest", "p")


def ranked(slim_docs: DataFrame, plan: DataFrame) -> DataFrame:
    """slim_docs with what the plan says of their source and level, and their cells in the Pareto ranking."""
    odds = F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) * (1 - F.col("p")) / F.col("p"))
    place = odds / (1 + odds) * CELLS
    extra = [c for c in plan.columns if c not in ("source", "level")]
    return (
        slim_docs.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.level") == F.col("p.level")))
        .select("d.*", *(f"p.{c}" for c in extra))
        .withColumn("place", F.least(place, F.lit(CELLS * (1 - 1e-9))))
        .withColumn("cell", F.floor("place").cast("int"))
        .withColumn("fine", F.floor((F.col("place") - F.col("cell")) * CELLS).cast("int"))
        .drop("place")
    )


def _end(hist: DataFrame, cell: str, left: str) -> DataFrame:
    """The cell of each source in which the words reach what is left, and the words before and in it."""
    upto = W.partitionBy("source").orderBy(cell).rowsBetween(W.unboundedPreceding, 0)
    x = hist.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") >= F.col(left))
    return x.groupBy("source").agg(F.min(F.struct(F.col(cell).alias("at"), (F.col("upto") - F.col("words")).alias("before"), F.col("words").alias("inside"))).alias("e"))


def mix_plan(slim_docs: DataFrame, weights: Sequence[float] | Mapping[str, float] = (5, 2, 1), max_repeats: int = 3, total: int | None = None, half_weight: float = 50.0) -> DataFrame:
    """All decisions of a mix, as a written table of one row per source and length level."""
    levels = written(slim_docs.groupBy("source", "level").agg(F.sum("size").alias("words")), "mix-levels")
    targets = source_targets(levels.select("source", F.col("words").alias("size")), weights, max_repeats, total)
    plan = written(inclusion(levels, targets, half_weight), "mix-inclusion")
    placed = ranked(slim_docs, plan).where(F.col("cell").isNotNull() & (F.col("size") > 0))
    coarse = written(_end(placed.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "cell", "rest"), "mix-coarse")
    inside = placed.alias("d").join(coarse.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.cell") == F.col("c.e.at")))
    fine = inside.groupBy("d.source", "fine").agg(F.sum("size").alias("words"), F.first(F.col("rest") - F.col("c.e.before")).alias("left"))
    fine = _end(fine, "fine", "left")
    last = (
        plan.alias("p")
        .join(coarse.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
        .join(fine.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left")
    )
    over = F.col("c.e.before") + F.col("f.e.before")
    nearer = F.abs(over + F.col("f.e.inside") - F.col("rest")) < F.abs(F.col("rest") - over)
    last = last.select("p.*", F.col("c.e.at").alias("last_cell"), F.when(nearer, F.col("f.e.at")).otherwise(F.col("f.e.at") - 1).alias("last_fine"))
    return written(last, "mix-plan")


def copies() -> Column:
    """Times that a ranked document is taken."""
    inside = (F.col("cell") < F.col("last_cell")) | ((F.col("cell") == F.col("last_cell")) & (F.col("fine") <= F.col("last_fine")))
    everything = F.col("last_cell").isNull() & F.col("cell").isNotNull() & (F.col("rest") > 0)  # rounding left the whole source short of its rest
    return (F.col("whole") + F.when(F.coalesce(inside, F.lit(False)) | everything, F.lit(1)).otherwise(F.lit(0))).cast("int")


def mix(docs: DataFrame, weights: Sequence[float] | Mapping[str, float] = (5, 2, 1), max_repeats: int = 3, total: int | None = None, half_weight: float = 50.0, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of every document."""
    x = written(slim(docs, seed), "mix-slim")
    plan = mix_plan(x, weights, max_repeats, total, half_weight)
    return ranked(x, plan).withColumn("copies", copies()).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as many times as it is taken (documents without words: as often as their
    source's whole copies, or once where there are none, for they weigh nothing)."""
    seed = options.pop("seed", 0)
    plan = mix_plan(written(slim(docs, seed), "mix-slim"), **options)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = row.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.text").alias("text"))
    keyed = slim(own, seed, "row")
    times = F.when((F.col("size") == 0) & (F.col("n") == 0), F.lit(1)).otherwise(F.col("n"))
    return ranked(keyed, plan).withColumn("n", copies()).select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).select("row.*")

