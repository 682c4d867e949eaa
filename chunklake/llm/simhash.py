"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 bits over shingles of words. Distinct fingerprints, not documents, are indexed, so copies of any number cost
one row. A fingerprint is cut into two segments of 32 bits. Two that differ in at most 3 bits differ in at most one bit in one
of the segments: so the Hamming ball of radius 1 is enumerated in each segment, the table's fingerprints with such a segment are
fetched, and each match is verified over all bits. Of two segments that differ in one bit, one has an even number of ones:
only these enumerate their ball, the others are looked up.

``near_copies`` uses the same tables to find copies at a similarity, not at a distance.

A bucket of the table may hold very many different near copies, of which not all pairs are made and none is lost. In
buckets of more than HOT nodes each node is first compared with PIVOTS nodes of the bucket; what they link is contracted to
components. Two nodes of one component need no further link. So in such a bucket nodes of its largest component
are not compared with each other: only nodes of other components are compared with all. The links that come out are not all
links, but they reach exactly the same documents.

Cases: null text is empty; a text without words has fingerprint zero and is linked like any other; fewer words than a shingle are
one shingle; null doc_id: such documents have fingerprints and can link others, and their component is null only if
it has no other document; repeated rows are documents like others; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import attached, written
from chunklake.llm.components import components
from chunklake.llm.tokens import chunks

BITS = 64
#: Shingles whose hashes are counted at a time: bounds the memory for a very long text.
PART = 1 << 14
#: Nodes in a bucket from which it counts as crowded, and pivots of such a bucket.
HOT, PIVOTS = 64, 8


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each base hash; the 0th is the base hash itself."""
    if not k:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(pieces: list[bytes], seed: int) -> int:
    """A bit is 1 if it is set in over half the pieces' hashes."""
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(pieces), PART):
        hashes = np.array([digest(p, seed) for p in pieces[i : i + PART]], np.uint64)
        total += np.unpackbits(hashes[:, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits((total * 2 > len(pieces)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Neighbouring words joined by spaces, repeats included; too few words are one shingle."""
    if not words:
        return []
    data = b" ".join(words)
    n = max(1, len(words) - size + 1)
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))[:n].tolist()
    ends = np.concatenate((spaces, [len(data)]))[size - 1 :].tolist() or [len(data)]
    return [data[a:b] for a, b in zip(starts, ends, strict=True)]


def fingerprint(text: bytes | None, words_in_shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text's shingles, as a signed number."""
    return majority(shingles(words_of(text), words_in_shingle), seed)


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """doc_id and node: the fingerprint."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(rows):
            own = pa.array([fingerprint(t, words_in_shingle) for t in c.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([c.column(0).cast(pa.int64()), own], ["doc_id", "node"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(batches, "doc_id long, node long")


def slots(nodes: DataFrame, segments: range, *others: str) -> DataFrame:
    """node, slot and other columns; slot: a segment's number (high half) and its 32 bits (low half); two segments for each of fps."""
    halves = []
    for i in segments:
        fp = F.get("fps", F.lit(i // 2))
        half = F.shiftrightunsigned(fp, 32) if i % 2 else fp.bitwiseAND(F.lit(0xFFFFFFFF))
        halves.append(half.bitwiseOR(F.lit(i << 32)))
    return nodes.select("node", *others, F.explode(F.array(*halves)).alias("slot"))


def probes(table: DataFrame) -> DataFrame:
    """table's rows for their own slots, and for all slots that differ in one bit where their own has an even number of ones."""
    own = F.col("slot")
    bits = own.bitwiseAND(F.lit(0xFFFFFFFF))
    ball = F.array(own, *(own.bitwiseXOR(F.lit(1 << i)) for i in range(32)))
    return table.withColumn("slot", F.explode(F.when(F.bit_count(bits) % 2 == 0, ball).otherwise(F.array(own))))


def verified(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs (u, v) that differ in at most ``most`` of all bits."""
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most)


def links(nodes: DataFrame, most: int = 3, hot: int = HOT, pivots: int = PIVOTS) -> DataFrame:
    """Pairs u < v that join the same nodes as all pairs of nodes (distinct fingerprints) at ``most`` differing bits would."""
    if most > 3:
        raise ValueError("two segments with balls of radius 1 find 3 differing bits at most")
    nodes = nodes.select("node", F.array("node").alias("fps"))
    table = written(slots(nodes, range(2)), "slots")
    both = [F.least("q.node", "t.node").alias("u"), F.greatest("q.node", "t.node").alias("v")]
    same = F.col("q.slot") == F.col("t.slot")
    crowded = written(table.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("slot"), "crowded-slots")
    if crowded.isEmpty():
        found = probes(table).alias("q").join(table.alias("t"), same & (F.col("q.node") != F.col("t.node"))).select(*both)
        return verified(found, most).distinct()

    # 1. links to pivots, and the components that they make
    inside = table.join(crowded, "slot", "left_semi")
    chosen = inside.groupBy("slot").agg(F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(pivots)))).alias("p")).select("slot", F.explode("p").alias("node"))
    first = inside.alias("q").join(chosen.alias("t"), same & (F.col("q.node") != F.col("t.node"))).select(*both).distinct()
    first = written(verified(first, most), "pivot-links")
    part = components(first).withColumnRenamed("node", "member")
    parted = nodes.join(part, F.col("node") == F.col("member"), "left").select("node", "fps", F.coalesce("component", "node").alias("part"))
    table = written(slots(parted, range(2), "part"), "slots-of-parts")
    # 2. each crowded slot's largest component
    sizes = table.join(crowded, "slot", "left_semi").groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n"))
    main = written(sizes.groupBy("slot").agg(F.max_by("part", F.struct("n", "part")).alias("main")), "main-parts")
    marked = table.join(main, "slot", "left")
    rare, many = marked.where(F.col("main").isNull() | (F.col("part") != F.col("main"))), marked.where(F.col("part") == F.col("main"))
    # 3. all are compared with the nodes outside the main parts, and main parts with the nodes of other parts only
    ask = probes(table)
    apart = same & (F.col("q.part") != F.col("t.part"))
    strangers = ask.join(main, "slot").where(F.col("part") != F.col("main"))
    found = ask.alias("q").join(rare.alias("t"), apart).select(*both).unionByName(strangers.alias("q").join(many.alias("t"), apart).select(*both)).distinct()
    return first.unionByName(verified(found, most)).distinct()


def clustered(docs: DataFrame, words_in_shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach)."""
    own = written(fingerprints(docs, words_in_shingle), "fingerprints")
    per = written(own.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "fingerprint-groups")
    member = components(links(per.select("node"), most)).withColumnRenamed("node", "member")
    least = per.join(member, F.col("node") == F.col("member"), "left").select("node", "n", F.coalesce("component", "node").alias("component"), "low")
    least = written(least, "fingerprint-components")
    roots = least.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = written(attached(least.withColumnRenamed("n", "rows"), roots, "component").select("node", "component_id", F.col("rows").alias("n")), "component-names")
    return attached(own, named, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
