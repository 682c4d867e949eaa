"""Exact deduplication against a persistent index of digests.

The index is a Parquet table bucketed and sorted by digest (digest, keep_id, group_size). A batch is reduced to one row per digest
(partial sums run before the shuffle, so a text of a third of all rows sends one row per task) and meets the index in one
sort-merge join, for which Spark shuffles the batch alone: the index is read by its buckets as it lies. The anti part of
that join is new and appended with the batch's smallest doc_id; of texts that the index holds, a row with the batch's count
is appended, and the index's rows of a digest are added up when read. So keep_id is who came first and stays, and
group_size counts all batches. Appending is one write job; a job that dies leaves no row in the table.

What is decided for a digest comes back to the batch's rows by a join in which no hot digest meets in one task (``attached``).

Texts are equal when identical after each run of ASCII white space became one space; null counts as empty.

Cases: a null doc_id counts as larger than any other (kept only where its group has no other); rows repeated in text and
doc_id share one decision and all count in group_size; an empty table gives an empty result; other columns aren't read
(``deduplicated`` keeps them).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm.common import SPACES, attached, plain, shuffle_cleanup, written

SCHEMA = "digest binary, keep_id bigint, group_size bigint"


def normalized(text: Column) -> Column:
    return F.regexp_replace(plain(text), SPACES, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalized(text), 256))


class DigestIndex:
    """A digest index in a folder that driver and executors share; opened again by its path and number of buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        """One row per digest; rows of a digest lie in one bucket, so that nothing is shuffled."""
        return self.spark.table(self.name).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def met(self, batch: DataFrame) -> DataFrame:
        """batch (digest, keep_id, n; one row per digest) with who stays, the size with this batch, and whether the index had it."""
        old = self.rows().select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"), F.lit(True).alias("old"))
        x = batch.join(old.hint("merge"), "digest", "left")
        keep = F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id"))
        return x.select("digest", keep.alias("keep_id"), "n", (F.col("n") + F.coalesce("old_size", F.lit(0))).alias("group_size"), F.coalesce("old", F.lit(False)).alias("old"))

    def append(self, rows: DataFrame) -> None:
        """One sorted file for each bucket."""
        with shuffle_cleanup(self.spark):
            rows.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)

    def add(self, digests: DataFrame) -> DataFrame:
        """Adds a batch of (doc_id, digest); what was decided for each of its digests (see ``met``), as a written table."""
        batch = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        # written first: what is appended must not be computed from the table that it is appended to
        out = written(self.met(batch), "digest-batch")
        self.append(out.select("digest", "keep_id", F.col("n").alias("group_size")))
        return out

    def close(self) -> None:
        """Takes the name out of the session's catalogue; the files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", digest(F.col("text")).alias("digest"))


def decisions(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Adds docs to the index; one row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    own = written(digests(docs), "digests")
    x = attached(own, index.add(own).drop("old"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return x.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs whose text neither the index nor another row of docs with a smaller doc_id holds.

    Rows equal in doc_id and text stay together.
    """
    new = index.add(digests(docs)).where(~F.col("old"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("digest", digest(F.col("row.text")))
    n = new.select(F.col("digest").alias("d"), "keep_id")
    return row.join(n, (F.col("digest") == F.col("d")) & F.col("row.doc_id").eqNullSafe(F.col("keep_id")), "left_semi").select("row.*")
