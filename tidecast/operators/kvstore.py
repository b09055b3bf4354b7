"""The keyed store as a log-structured table: batches append, buckets are merged in turn.

Keys fall into ``buckets`` by hash. A commit reduces its batch to the latest write of each key and writes those
rows only; one class of buckets (bucket modulo ``turns`` equal to the version modulo ``turns``) is merged
whole on the way, so each bucket is rewritten once in ``turns`` commits and a read meets at most ``turns``
small files beside a bucket's merged one. What a commit writes is therefore its batch and a ``turns``-th of
the store.

A version's manifest names, for each turn, the version that merged its buckets last, and the directories of the
commits since the oldest of those: a few kilobytes, whatever the store's size. A bucket's rows are its merged file of
its turn's version and the batches after it; the filter on directories prunes the scan. A manifest is created only
where none is, and never overwritten: of two writers that race for a version one fails, reads the winner's version and
merges again. One left half written is passed over. A batch id that was committed is not applied again, so a replayed
stream batch changes nothing. ``vacuum`` deletes what no kept version reads.

Rows are ``(key, value, written_at, seq, ttl_seconds, deleted)``; the greatest (written_at, seq) of a key wins, a
null key is no key and is left out, and a deletion is a write that hides the key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kv import WRITE_COLS, latest_per_key, with_expiry

SCHEMA = "key STRING, value STRING, written_at TIMESTAMP_NTZ, seq BIGINT, ttl_seconds BIGINT, deleted BOOLEAN"
COLUMNS = (*WRITE_COLS, "deleted")
BUCKETS, TURNS = 64, 32
ATTEMPTS = 10  # lost races before a commit gives up


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Files:
    """The few file-system calls that a manifest needs, through the session's own file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; raises ``Conflict`` if it exists."""
        target = self.path(f"{self.root}/{name}")
        try:
            out = self.fs.create(target, False)
        except Exception as e:  # noqa: BLE001 - the file system's own exception for an existing file
            if self.fs.exists(target):
                raise Conflict(name) from e
            raise
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


class KeyedStore:
    """A store at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, turns: int = TURNS):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        told = self.manifest()
        self.buckets, self.turns = (told["buckets"], told["turns"]) if told else (buckets, turns)

    def versions(self) -> list[int]:
        return [int(n.removeprefix("v").removesuffix(".json")) for n in self.files.names("manifest")
                if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or the newest whole one; None for an empty store."""
        for v in sorted(self.versions(), reverse=True):
            if version in (None, v):
                try:
                    return json.loads(self.files.read(f"manifest/v{v:012d}.json"))
                except json.JSONDecodeError:
                    continue  # its writer died
        return None

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def rows(self, version: int | None = None, of_turn: int | None = None) -> DataFrame:
        """All live writes: at most one merged row and a few newer ones for each key, deletions among them."""
        told = self.manifest(version)
        if not told:
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket INT")
        dirs = [f"{self.path}/data/version={c['version']}/attempt={c['attempt']}" for c in told["commits"]]
        rows = self.spark.read.schema(f"{SCHEMA}, version BIGINT, attempt STRING, kind STRING, bucket INT").option(
            "basePath", f"{self.path}/data").parquet(*dirs)
        turn = F.pmod("bucket", F.lit(told["turns"]))
        merged = F.element_at(F.array(*[F.lit(v) for v in told["merged"]]), turn + 1)
        live = ((F.col("kind") == "merged") & (F.col("version") == merged)) | ((F.col("kind") == "batch") & (F.col("version") > merged))
        if of_turn is not None:
            live &= turn == of_turn
        return rows.where(live).select(*COLUMNS, "bucket")

    def read(self, as_of: str | None = None, version: int | None = None) -> DataFrame:
        """The current row of each key, with ``expires_at``; with ``as_of``, without keys expired by then."""
        now = with_expiry(latest_per_key(self.rows(version).select(*COLUMNS), "key", "written_at", "seq"))
        now = now.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")
        if as_of is None:
            return now
        return now.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")))

    def commit(self, writes: DataFrame, batch_id: int | None = None) -> int:
        """Apply writes as the next version, which is returned; a ``batch_id`` already applied changes nothing."""
        if "deleted" not in writes.columns:
            writes = writes.withColumn("deleted", F.lit(False))
        for _ in range(ATTEMPTS):
            told = self.manifest() or {"version": 0, "batch": None, "commits": [], "merged": [0] * self.turns}
            if batch_id is not None and told["batch"] is not None and batch_id <= told["batch"]:
                return told["version"]
            version, attempt = max(self.versions(), default=0) + 1, uuid.uuid4().hex
            own = version % self.turns
            new = writes.select(*COLUMNS).where("key is not null").withColumn("bucket", self._bucket())
            both = new.withColumn("kind", F.when(F.pmod("bucket", F.lit(self.turns)) == own, "merged").otherwise("batch"))
            if told["commits"]:
                both = both.unionByName(self.rows(told["version"], own).withColumn("kind", F.lit("merged")))
            (latest_per_key(both, ["kind", "bucket", "key"], "written_at", "seq").repartition(self.buckets, "bucket")
             .write.partitionBy("kind", "bucket").parquet(f"{self.path}/data/version={version}/attempt={attempt}"))
            merged = [version if turn == own else v for turn, v in enumerate(told["merged"])]
            commits = [c for c in told["commits"] if c["version"] >= min(merged)] + [{"version": version, "attempt": attempt}]
            try:
                self.files.create(f"manifest/v{version:012d}.json", json.dumps({
                    "version": version, "batch": told["batch"] if batch_id is None else batch_id, "buckets": self.buckets,
                    "turns": self.turns, "merged": merged, "commits": commits}))
                return version
            except Conflict:
                self.files.delete(f"data/version={version}/attempt={attempt}")
        raise Conflict(f"no version could be made in {ATTEMPTS} attempts")

    def delete(self, keys: DataFrame, written_at: str, batch_id: int | None = None) -> DataFrame:
        """Hide keys from ``written_at`` on; returns those of them that the version before held."""
        before = (self.manifest() or {}).get("version")
        gone = keys.select("key").where("key is not null").distinct()
        self.commit(gone.select(
            "key", F.lit(None).cast("string").alias("value"), F.lit(written_at).cast("timestamp_ntz").alias("written_at"),
            F.lit(2**63 - 1).alias("seq"), F.lit(None).cast("bigint").alias("ttl_seconds"), F.lit(True).alias("deleted")), batch_id)
        return self.read(version=before).join(gone, "key", "left_semi").select("key") if before else gone.where("false")

    def vacuum(self, keep: int = 1) -> list[int]:
        """Delete the versions that none of the newest ``keep`` manifests reads; returns them."""
        found = sorted(self.versions())
        kept = found[-keep:]
        live = {(c["version"], c["attempt"]) for v in kept for c in (self.manifest(v) or {"commits": []})["commits"]}
        gone = []
        for name in self.files.names("data"):
            version = int(name.split("=")[1])
            if version > max(kept, default=0):
                continue  # a commit under way
            for attempt in self.files.names(f"data/{name}"):
                if (version, attempt.split("=")[1]) not in live:
                    self.files.delete(f"data/{name}/{attempt}")
                    gone.append(version)
        for v in found[:-keep]:
            self.files.delete(f"manifest/v{v:012d}.json")
        return sorted(set(gone))
