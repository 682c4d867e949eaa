"""Conversion of worlds (folders of region files) to stores and back; resumable, never touching its source."""

from __future__ import annotations

import os
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.config import Config
from chunklake.functions.codecs import decompressed, gzip_payload
from chunklake.operators import latest as L
from chunklake.schema import TYPES
from chunklake.sources import readers
from chunklake.store import Store, StoreError


#: Region files that are imported in one job and one commit.
BATCH = 256


def distinct_roots(folders: list[tuple[str, Path]]) -> list[tuple[str, Path]]:
    """The folders in their order, those that lead to the same place (by links) once."""
    seen: set[Path] = set()
    return [(label, p) for label, p in folders if not (p.resolve() in seen or seen.add(p.resolve()))]


def _candidates(world: str) -> list[tuple[str, Path]]:
    root = Path(world)
    found = [(".", root), *((n, root / n) for n in ("DIM-1", "DIM1"))]
    return distinct_roots(found + [(str(p.relative_to(root)), p) for p in sorted(root.glob("dimensions/*/*"))])


def dimensions(world: str) -> list[tuple[str, Path]]:
    """Label and folder of each dimension: the world itself, DIM-1, DIM1, and dimensions/<namespace>/<name>; those that have records."""
    return [(label, p) for label, p in _candidates(world) if any((p / folder).is_dir() for _, folder, _ in TYPES)]


def stores(world: str, name: str = "store") -> list[tuple[str, Path]]:
    """Label and path of each store under a world and its dimensions, those of which only the copy of a recompression is left too."""
    found = [(label, p / name) for label, p in _candidates(world)]
    return [(label, p) for label, p in found if (p / "pointer.json").exists() or (p.with_name(p.name + ".old") / "pointer.json").exists()]


def preflight(root: str, recompressing: bool = False) -> list[str]:
    """Cleans up what a recompression that died left beside a store; says what it did. With a store and a copy of it nothing is guessed."""
    own, done = Path(root), []
    old, new = own.with_name(own.name + ".old"), own.with_name(own.name + ".new")
    if own.exists() and old.exists() and not recompressing:
        raise StoreError(f"{own} and {old} both exist; keep the one that counts")
    if not own.exists() and old.exists():
        old.rename(own)
        done.append(f"{own} was restored from {old.name}")
    if own.exists() and new.exists():
        shutil.rmtree(new)
        done.append(f"{new} was unfinished and is deleted")
    return done


def failed(verb: str, failures: list[tuple[str, Exception]]) -> None:
    """One error that tells all dimensions that failed, if any did."""
    if failures:
        raise StoreError("; ".join([f"{verb}: {len(failures)} failed", *(f"{label}: {e}" for label, e in failures)]))


def _regions(folder: Path) -> list[tuple[int, int, Path]]:
    named = [(re.fullmatch(r"r\.(-?\d+)\.(-?\d+)\.mca", p.name), p) for p in folder.glob("r.*.mca")]
    return sorted((int(m[1]), int(m[2]), p) for m, p in named if m)


def convert_in(spark: SparkSession, world: str, store: Store, force: bool = False) -> dict[str, int]:
    """Imports all region files, BATCH of them in one commit; regions that the store's progress file marks are skipped.

    A batch's marks are in the commit that writes its rows and go from there to the progress file, so that after a crash no region is
    written twice or left out. A dimension that fails doesn't stop the others; all failures are told at the end. A store with
    rows that no import made is left alone without ``force``.
    """
    progress = store.root / "progress"
    if not force and not progress.exists() and store.state()["hot"] and not store.state().get("marks"):
        raise StoreError(f"{store.root} has rows that no import made")

    def mark(lines: list[str]) -> None:
        with progress.open("a") as f:
            f.writelines(line + "\n" for line in lines)
            f.flush()
            os.fsync(f.fileno())

    done = set(progress.read_text().splitlines()) if progress.exists() else set()
    pending = [m for m in store.state().get("marks", []) if m not in done]
    if pending:
        mark(pending)
        done |= set(pending)
    out, failures = {"regions": 0, "records": 0, "skipped": 0}, []
    for label, base in dimensions(world):
        try:
            for type_id, folder, name in TYPES:
                every = [(f"{label}:{name}:r{rx}.{rz}", p) for rx, rz, p in _regions(base / folder)]
                due = [(m, p) for m, p in every if m not in done]
                out["skipped"] += len(every) - len(due)
                for i in range(0, len(due), BATCH):
                    marks, paths = zip(*due[i : i + BATCH], strict=True)
                    chunks = readers.region_files(spark, [p.resolve().as_uri() for p in paths])
                    rows = chunks.select(F.lit(label).alias("dim"), "x", "z", F.lit(type_id).alias("type_id"), gzip_payload("nbt").alias("payload"))
                    out["records"] += store.write(rows, flush=True, marks=list(marks))
                    mark(list(marks))
                    out["regions"] += len(marks)
        except Exception as e:  # noqa: BLE001  told below, with the dimension
            failures.append((label, e))
    failed("convert-in", failures)
    return out


def exportable(store: Store) -> DataFrame:
    """Plain payloads of the latest readable rows of known types, hot and cold, without tombstones."""
    x = L.region_project(store.latest().where((F.col("plen") > 0) & ~F.col("corrupt")))
    return L.with_type_names(x.withColumn("payload", decompressed("payload", "comp_id")))


def convert_out(store: Store, target: str, force: bool = False) -> DataFrame:
    """Writes region files under target; returns their paths and lengths."""
    t = Path(target)
    if not force and t.exists() and any(t.rglob("*.mca")):
        raise StoreError(f"{target} has region files already")
    t.mkdir(parents=True, exist_ok=True)
    return readers.write_region_files(exportable(store).select("dim", "dir", "rx", "rz", "x", "z", "payload"), t.resolve().as_uri())


def recompress(spark: SparkSession, store: Store, root: str) -> Store:
    """A new store with the current configuration and the same latest rows; compared record by record before it is returned."""
    new = Store.open(spark, root, store.config)
    plain = store.latest().withColumn("payload", decompressed("payload", F.when(F.col("plen") == 0, F.lit(0)).otherwise(F.col("comp_id"))))
    new.write(plain.select("dim", "x", "z", "type_id", "payload", F.col("gen").alias("order")))
    new.flush()
    k = ["dim", "x", "z", "type_id"]
    again = new.latest().withColumn("payload", decompressed("payload", F.when(F.col("plen") == 0, F.lit(0)).otherwise(F.col("comp_id"))))
    both = plain.select(*k, F.md5("payload").alias("a")).join(again.select(*k, F.md5("payload").alias("b")), k, "full_outer")
    if both.where(~F.col("a").eqNullSafe(F.col("b"))).count():
        new.close()
        raise StoreError("the new store differs from the old one; nothing was replaced")
    return new


def recompress_in_place(spark: SparkSession, root: str, config: Config) -> int:
    """Rewrites a store with the current configuration beside itself (.new), compares, and swaps; the original stays as .old. Whatever
    fails leaves the original as it is. Returns the number of rows."""
    preflight(root, recompressing=True)
    own = Path(root)
    old, new = own.with_name(own.name + ".old"), own.with_name(own.name + ".new")
    try:
        with Store.open(spark, root, config) as store, recompress(spark, store, str(new)) as made:
            n = made.latest().count()
    except BaseException:
        shutil.rmtree(new, ignore_errors=True)
        raise
    if old.exists():
        shutil.rmtree(old)
    own.rename(old)
    try:
        new.rename(own)
    except OSError:
        old.rename(own)
        raise
    return n
