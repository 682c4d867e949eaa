from decimal import ROUND_HALF_UP, Decimal

from oracle import SMALL
from pyspark.sql import functions as F

from chunklake.functions.scalar import human_bytes
from chunklake.plans.queries import QUERIES


def shown(n):
    for k, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        if n >= 1024**k:
            return f"{(Decimal(n) / 1024**k).quantize(Decimal('0.1'), ROUND_HALF_UP)} {unit}"
    return f"{n} B"


def test_every_row_of_the_log_is_shown(spark):
    assert QUERIES["human_bytes"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_every_unit(spark):
    sizes = [0, 1023, 1024, 1536, 2**20 - 1, 2**20, 5 * 2**18, 2**30 - 1, 2**30, 3 * 2**29, 5 * 2**28, 7 * 2**30 + 12345, 2**41]
    got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", human_bytes(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: shown(n) for n in sizes}
