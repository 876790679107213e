"""Configuration, fingerprints, locks, content-keyed caches and runs."""

from __future__ import annotations

import contextlib
import hashlib
import json
import shutil
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from talweg.functions.physics import RANGES
from talweg.sources.stores import write_json

WORKFLOWS = ("baseline", "evaluate", "train")


@dataclass(frozen=True)
class Config:
    """What a run needs. ``testing`` replaces fields in testing mode; contradictions are errors."""

    workflow: str = "baseline"
    mode: str = "training"
    start: str = "1995-10-01"
    end: str = "2010-09-30"
    rho: int | None = 90
    tau: int = 9
    warmup: int = 5
    batch_size: int = 64
    legacy: bool = False
    enforce_positivity: bool = True
    max_pieces: int = 8
    ranges: dict = field(default_factory=lambda: dict(RANGES))
    sources: dict = field(default_factory=dict)
    testing: dict = field(default_factory=dict)

    @classmethod
    def load(cls, values: dict) -> Config:
        unknown = set(values) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        c = cls(**values)
        return (replace(c, **c.testing) if c.mode == "testing" else c).checked()

    def checked(self) -> Config:
        faults = [
            (self.workflow not in WORKFLOWS, f"workflow must be one of {WORKFLOWS}"),
            (self.start > self.end, "start is after end"),
            (not 0 <= self.tau < 24, "tau must be in [0, 24)"),
            (self.rho is not None and self.rho < 2, "rho must be 2 days or more"),
            (self.rho is not None and self.warmup >= self.rho - 1, "warmup leaves no day"),
            (self.legacy and self.max_pieces > 1 and self.workflow == "train", "subdivision needs the corrected physics"),
            (any(lo >= hi for lo, hi in self.ranges.values()), "a range is empty"),
            (self.batch_size < 1, "batch_size must be positive"),
        ]
        for bad, why in faults:
            if bad:
                raise ValueError(why)
        return self


def parse_yaml(text: str) -> dict:
    """The part of YAML that configurations use: nested mappings by indentation, lists of scalars in brackets, scalars, comments."""

    def scalar(x: str):
        x = x.strip()
        if x.startswith("[") and x.endswith("]"):
            return [scalar(y) for y in x[1:-1].split(",") if y.strip()]
        if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
            return x[1:-1]
        if x.lower() in ("null", "~", ""):
            return None
        if x.lower() in ("true", "false"):
            return x.lower() == "true"
        for kind in (int, float):
            with contextlib.suppress(ValueError):
                return kind(x)
        return x

    root: dict = {}
    levels: list[tuple[int, dict]] = [(-1, root)]
    open_: list[tuple[dict, str]] = []
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth = len(bare) - len(bare.lstrip())
        key, colon, value = bare.strip().partition(":")
        if not colon or "\t" in bare[:depth]:
            raise ValueError(f"line {number} is no mapping: {line}")
        while levels[-1][0] >= depth:
            levels.pop()
        here = levels[-1][1]
        if key in here:
            raise ValueError(f"line {number}: {key} is given twice")
        if value.strip():
            here[key] = scalar(value)
        else:
            here[key] = {}
            levels.append((depth, here[key]))
            open_.append((here, key))
    for here, key in open_:
        here[key] = here[key] or None
    return root


def load_config(path: str, mode: str | None = None) -> Config:
    """A configuration from a YAML or JSON file; ``mode`` overrides the one in the file."""
    text = Path(path).read_text()
    values = json.loads(text) if path.endswith(".json") else parse_yaml(text)
    if isinstance(values.get("ranges"), dict):
        values["ranges"] = dict(RANGES) | {k: tuple(v) for k, v in values["ranges"].items()}
    return Config.load(values | ({"mode": mode} if mode else {}))


def fingerprint(path: str, known: dict | None = None) -> dict:
    """Size, times and content hash of a file or folder; if size and times are as known, the known hash is kept."""
    root = Path(path)
    files = sorted(p for p in (root.rglob("*") if root.is_dir() else [root]) if p.is_file())
    stat = {"size": sum(p.stat().st_size for p in files), "mtime": max((p.stat().st_mtime_ns for p in files), default=0)}
    if known and all(known.get(k) == v for k, v in stat.items()):
        return known
    h = hashlib.sha256()
    for p in files:
        h.update(str(p.relative_to(root) if root.is_dir() else p.name).encode())
        with p.open("rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
    return stat | {"sha256": h.hexdigest()}


def lock_differences(lock: dict, live: dict) -> dict[str, str]:
    """Keys added, removed or changed."""
    out = {k: "removed" for k in lock.keys() - live.keys()} | {k: "added" for k in live.keys() - lock.keys()}
    return out | {k: "changed" for k in lock.keys() & live.keys() if lock[k].get("sha256") != live[k].get("sha256")}


def cache_key(version: str, inputs: dict, config: Config | None = None) -> str:
    """The name of a result by what it is made of."""
    parts = [version, *sorted(f"{k}={v.get('sha256', v) if isinstance(v, dict) else v}" for k, v in inputs.items())]
    if config:
        parts.append(repr(sorted(asdict(config).items())))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


def resolve_or_build(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table under ``key``, and whether it was there: Spark's success mark tells a whole one from a broken one."""
    path = f"{root}/{key}"
    jvm = spark._jvm.org.apache.hadoop.fs
    mark = jvm.Path(f"{path}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.parquet(path), True
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False


def plan(config: Config, lock: dict | None = None, strict: bool = False) -> dict:
    """Validate, fingerprint the sources, compare them with the lock; strict fails on any difference."""
    config.checked()
    live = {k: fingerprint(p, (lock or {}).get(k)) for k, p in config.sources.items()}
    diff = lock_differences(lock or {}, live) if lock is not None else {}
    if strict and diff:
        raise ValueError(f"the sources differ from the lock: {diff}")
    return {"config": asdict(config), "lock": live, "drift": diff}


def run(config: Config, work: Callable[[Config], dict], root: str, name: str | None = None) -> dict:
    """Do the work and leave a manifest, also when it fails."""
    run_id = name or time.strftime("%Y%m%d-%H%M%S")
    folder = Path(root, run_id)
    folder.mkdir(parents=True, exist_ok=True)
    manifest = {"id": run_id, "workflow": config.workflow, "status": "failed", "started": time.time()}
    try:
        manifest |= {"result": work(config), "status": "done"}
    except Exception as e:
        manifest["error"] = f"{type(e).__name__}: {e}"[:2000]
        raise
    finally:
        write_json(str(folder / "manifest.json"), manifest | {"ended": time.time()})
    return manifest


def status(root: str) -> list[str]:
    """Run ids, newest first."""
    return sorted((p.parent.name for p in Path(root).glob("*/manifest.json")), reverse=True)


def show(root: str, run_id: str) -> dict:
    """The manifest of a run; an unknown run is an error."""
    path = Path(root, run_id, "manifest.json")
    if not path.is_file():
        raise ValueError(f"no run {run_id}")
    return json.loads(path.read_text())


class Groups:
    """Named groups of sources, kept in one file of a workspace: import checks them, save adds one, use picks the current one."""

    def __init__(self, workspace: str):
        self.path = Path(workspace, "groups.json")
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def _read(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {"current": None, "groups": {}}

    def save(self, name: str, sources: dict[str, str]) -> dict:
        """Register a group with the fingerprints of its sources; a source that is not there is an error."""
        lost = sorted(k for k, p in sources.items() if not Path(p).exists())
        if lost or not name.strip():
            raise ValueError(f"group {name!r}: sources not found {lost}")
        all_ = self._read()
        all_["groups"][name] = {k: {"path": p} | fingerprint(p) for k, p in sources.items()}
        write_json(str(self.path), all_)
        return all_["groups"][name]

    def load(self, path: str) -> list[str]:
        """Import the groups of a YAML or JSON file {group: {source: path}}; all are checked before any is registered."""
        text = Path(path).read_text()
        given = json.loads(text) if path.endswith(".json") else parse_yaml(text)
        for name, sources in given.items():
            lost = sorted(k for k, p in sources.items() if not Path(p).exists())
            if lost:
                raise ValueError(f"group {name!r}: sources not found {lost}")
        for name, sources in given.items():
            self.save(name, sources)
        return sorted(given)

    def use(self, name: str) -> None:
        all_ = self._read()
        if name not in all_["groups"]:
            raise ValueError(f"no group {name!r}")
        write_json(str(self.path), all_ | {"current": name})

    def list(self) -> list[tuple[str, bool, int]]:
        """(name, in use, number of sources), by name."""
        all_ = self._read()
        return [(k, k == all_["current"], len(g)) for k, g in sorted(all_["groups"].items())]


def gc(root: str, keep: int | None = None, prefix: str | None = None) -> list[str]:
    """Remove all but the newest ``keep`` runs, of those with ``prefix``; without a filter nothing goes."""
    if keep is None and prefix is None:
        return []
    runs = [r for r in status(root) if prefix is None or r.startswith(prefix)]
    gone = runs[keep or 0 :]
    for r in gone:
        shutil.rmtree(Path(root, r))
    return gone


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """The tables of a folder as SQL views."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
