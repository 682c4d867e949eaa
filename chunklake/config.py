"""Configuration: a properties file whose keys are ``<prefix>.<name>``, and what follows from combinations of switches."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, fields
from pathlib import Path

FILE = "store.properties"
#: Property name, field and parser of each key. Names are fixed values of the file format.
NAMES = {
    "enabled": "enabled",
    "tiering.enabled": "cold_enabled",
    "tiering.stable-flushes": "stable_flushes",
    "tiering.invalid-demote-ratio": "demote_ratio",
    "compression.hot-enabled": "hot_compression",
    "compression.cold-enabled": "cold_compression",
    "compression.hot": "hot_level",
    "compression.cold": "cold_level",
    "compression.threads": "threads",
    "index.cache-mb": "cache_mb",
    "gc.enabled": "gc_enabled",
    "gc.invalid-threshold": "gc_threshold",
    "gc.budget-bytes": "gc_budget",
    "gc.min-hole-bytes": "gc_min_hole",
    "force-anvil": "force_external",
}


class ConfigError(ValueError):
    """A bad value, with its line."""


@dataclass
class Config:
    enabled: bool = False
    cold_enabled: bool = True
    stable_flushes: int = 30
    demote_ratio: float = 0.25
    hot_compression: bool = True
    cold_compression: bool = True
    hot_level: int = 3
    cold_level: int = 9
    threads: int = 1
    cache_mb: int = 512
    gc_enabled: bool = True
    gc_threshold: float = 0.6
    gc_budget: int = 32 << 20
    gc_min_hole: int = 64 << 10
    force_external: bool = False


def template(prefix: str = "store") -> str:
    shown = {"hot_level": lambda v: f"zstd-{v}", "cold_level": lambda v: f"zstd-{v}"}
    c = Config()
    out = []
    for name, field in NAMES.items():
        v = getattr(c, field)
        out.append(f"{prefix}.{name}={shown[field](v) if field in shown else str(v).lower()}")
    return "# The store is off unless enabled is true.\n" + "\n".join(out) + "\n"


def logical_lines(text: str) -> list[tuple[int, str]]:
    """Lines with their first physical line's number: comments dropped, continuations joined."""
    out: list[tuple[int, str]] = []
    open_ = False
    for n, line in enumerate(text.removeprefix("﻿").splitlines(), 1):
        if not open_ and (not line.strip() or line.lstrip()[0] in "#!"):
            continue
        more = line.endswith("\\")
        body = line[:-1] if more else line
        if open_:
            out[-1] = (out[-1][0], out[-1][1] + body.strip())
        else:
            out.append((n, body))
        open_ = more
    return out


def _value(field: str, text: str) -> object:
    if field in ("hot_level", "cold_level"):
        if field == "hot_level" and text == "none":
            return None
        m = re.fullmatch(r"zstd-(-?\d+)", text)
        if not m or not -10 <= int(m[1]) <= 22 or int(m[1]) == 0:
            raise ValueError("must be zstd-N, N from -10 to 22 and not 0")
        return int(m[1])
    kind = {f.name: f.type for f in fields(Config)}[field]
    if kind == "bool":
        if text not in ("true", "false"):
            raise ValueError("must be true or false")
        return text == "true"
    if kind == "float":
        v = float(text)
        if not 0 <= v <= 1:
            raise ValueError("must be from 0 to 1")
        return v
    v = int(text)
    if v < 0:
        raise ValueError("must not be negative")
    return v


def parse(text: str, prefix: str = "store") -> Config:
    pairs = []
    for n, line in logical_lines(text):
        key, found, value = line.partition("=")
        if found and key.strip().startswith(f"{prefix}."):
            pairs.append((n, key.strip()[len(prefix) + 1 :], value.strip()))
        else:
            warnings.warn(f"line {n}: ignored", stacklevel=2)
    if ("enabled", "false") in [(k, v) for _, k, v in pairs]:
        return Config()
    out = Config()
    for n, name, value in pairs:
        if name not in NAMES:
            warnings.warn(f"line {n}: unknown key {name}", stacklevel=2)
            continue
        try:
            parsed = _value(NAMES[name], value)
            if parsed is None:
                out.hot_compression = False
            else:
                setattr(out, NAMES[name], parsed)
        except ValueError as e:
            raise ConfigError(f"line {n}: {name}: {e}") from e
    return out


def load(folder: str, prefix: str = "store") -> Config:
    """The configuration in a folder; the template is written where there is none."""
    p = Path(folder) / FILE
    if not p.exists():
        p.write_text(template(prefix))
    return parse(p.read_text(), prefix)


def advice(c: Config) -> list[str]:
    """Warnings for combinations that undo each other."""
    out = []
    if c.enabled and c.force_external:
        out.append("the store is enabled but reads are forced to the external files")
    if not c.cold_enabled and c.cold_compression:
        out.append("cold compression has no effect without the cold tier")
    if c.threads != 1 or c.cache_mb != 512:
        out.append("threads and the index cache have no effect: tasks compress in parallel, and files are read through the session's cache")
    if not c.hot_compression and not c.cold_compression:
        out.append("nothing is compressed")
    if not c.gc_enabled and c.gc_threshold < 0.5:
        out.append("a collection threshold is set but collection is off")
    return out
