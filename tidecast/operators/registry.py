"""Model registry: versioned Spark ML model folders, switched by manifests that are created once.

A save writes the model to a new folder, then creates the next manifest of its name, which lists the live versions,
newest last; readers take the newest manifest's last entry. So there is no moment without a model, a reader meets a
whole list or the one before, and of two writers that race one fails, reads the other's manifest and adds to that.
``append`` keeps the versions before it (the newest ``KEEP``), ``replace`` is the one live version from its manifest on,
``retire`` takes a version out, and ``expire`` deletes the folders that the newest manifests do not name.

The registry lies in ``root``, or in ``spark.tidecast.registry``, or in the folder that driver and executors share;
set one of the first two to keep models beyond a checkpoint folder's life.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Row, SparkSession

from ..session import scratch_path
from .kvstore import ATTEMPTS, Conflict, Files

SETTING = "spark.tidecast.registry"
KEEP = 100


def registry_root(spark: SparkSession, root: str | None = None) -> str:
    return root or spark.conf.get(SETTING, None) or scratch_path(spark, "registry")


def _files(spark: SparkSession, root: str | None) -> Files:
    return Files(spark, registry_root(spark, root))


def _numbers(files: Files, name: str) -> list[int]:
    return [int(n[1:-5]) for n in files.names(f"manifests/{name}") if n.startswith("v") and n.endswith(".json")]


def live(spark: SparkSession, name: str, root: str | None = None) -> list[dict]:
    """The live versions of ``name``, newest last: dicts of version, path, trained_at, metrics."""
    files = _files(spark, root)
    for n in sorted(_numbers(files, name), reverse=True):
        try:
            return json.loads(files.read(f"manifests/{name}/v{n:012d}.json"))
        except json.JSONDecodeError:
            continue  # its writer died
    return []


def _switch(spark: SparkSession, name: str, root: str | None, change) -> list[dict]:
    """Make ``change(live versions, next number)`` the live versions."""
    files = _files(spark, root)
    for _ in range(ATTEMPTS):
        number = max(_numbers(files, name), default=0) + 1
        now = change(live(spark, name, root), number)
        try:
            files.create(f"manifests/{name}/v{number:012d}.json", json.dumps(now))
            return now
        except Conflict:
            continue
    raise Conflict(f"no manifest of {name!r} could be made in {ATTEMPTS} attempts")


def save(spark: SparkSession, model, name: str, metrics: dict | None = None, root: str | None = None, replace: bool = False) -> str:
    """Write a model and make it the newest version (the only one, if ``replace``); returns its path."""
    at = datetime.now(timezone.utc).replace(tzinfo=None)
    path = f"{registry_root(spark, root)}/models/{name}/{at:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    model.write().overwrite().save(path)
    told = {k: float(v) for k, v in (metrics or {}).items()}
    _switch(spark, name, root, lambda old, number: [*([] if replace else old[-(KEEP - 1):]), {
        "version": number, "path": path, "trained_at": at.isoformat(), "metrics": told}])
    return path


def retire(spark: SparkSession, name: str, version: int, root: str | None = None) -> None:
    """Take a version out of the live ones; its folder stays until ``expire``."""
    if all(v["version"] != version for v in live(spark, name, root)):
        raise ValueError(f"model {name!r} has no live version {version}")
    _switch(spark, name, root, lambda old, _: [v for v in old if v["version"] != version])


def expire(spark: SparkSession, name: str, root: str | None = None) -> int:
    """Delete what only manifests before the newest name; returns how many model folders went.

    For use while no save is under way: a folder whose manifest is still to come looks like one that is gone.
    """
    files = _files(spark, root)
    kept = {v["path"].rsplit("/", 1)[1] for v in live(spark, name, root)}
    gone = [n for n in files.names(f"models/{name}") if n not in kept]
    for n in gone:
        files.delete(f"models/{name}/{n}")
    for n in sorted(_numbers(files, name))[:-1]:
        files.delete(f"manifests/{name}/v{n:012d}.json")
    return len(gone)


def latest(spark: SparkSession, name: str, root: str | None = None) -> Row:
    """The newest live version of ``name``; raises when there is none."""
    versions = live(spark, name, root)
    if not versions:
        raise ValueError(f"model {name!r} not found in the registry")
    v = versions[-1]
    return Row(model_name=name, version=v["version"], path=v["path"], trained_at=datetime.fromisoformat(v["trained_at"]), metrics=v["metrics"])


def load(spark: SparkSession, name: str, loader, root: str | None = None):
    """``loader`` is the model class (e.g. ``PipelineModel``) whose ``load`` reads the folder."""
    return loader.load(latest(spark, name, root)["path"])
