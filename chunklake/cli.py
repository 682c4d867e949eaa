"""Commands: convert-in, convert-out, verify, compact, recompress, stats."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from chunklake import config as C
from chunklake import convert
from chunklake.store import Store, StoreError


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="chunklake", description=__doc__)
    p.add_argument("verb", choices=["convert-in", "convert-out", "verify", "compact", "recompress", "stats"])
    p.add_argument("store")
    p.add_argument("other", nargs="?", help="the world to convert from or to")
    p.add_argument("--force", action="store_true")
    p.add_argument("--config", help="a folder with a properties file")
    a = p.parse_args(args)
    if a.verb in ("convert-in", "convert-out") and not a.other:
        p.error(f"{a.verb} needs a second path")
    spark = spark or SparkSession.builder.appName("chunklake").getOrCreate()
    try:
        cfg = C.load(a.config) if a.config else C.Config(enabled=True)
        for line in C.advice(cfg):
            print("warning:", line, file=sys.stderr)
        if a.verb == "recompress":
            print({"records": convert.recompress_in_place(spark, a.store, cfg)})
            return 0
        for line in convert.preflight(a.store):
            print("warning:", line, file=sys.stderr)
        with Store.open(spark, a.store, cfg) as store:
            if a.verb == "convert-in":
                print(convert.convert_in(spark, a.other, store, a.force))
            elif a.verb == "convert-out":
                n = convert.convert_out(store, a.other, a.force).collect()  # one row for each file
                print({"files": len(n), "bytes": sum(r.length for r in n)})
            elif a.verb == "verify":
                r = store.verify().first().asDict()
                print(r)
                return int(r["corrupt_latest"] > 0)
            elif a.verb == "compact":
                print({"passes": store.compact()})
            else:
                print(store.stats().first().asDict())
    except (StoreError, C.ConfigError) as e:
        print("error:", e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
