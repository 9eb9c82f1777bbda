"""A table's version log as Parquet folders under a manifest: append is commit, readers see whole commits only.

A commit writes its rows to a folder of their own and then publishes manifest n + 1, which lists the live folders. A
manifest is a file that may be created once, so of two writers that start from the same state one fails and retries.
Manifests carry a checksum; a torn one is skipped and the one before it counts. Nothing is changed in place: readers
keep the files they have listed until vacuum() removes what no manifest names, which spares staged and pinned folders
and those that left the manifests less than a grace period ago.

Folders have levels: an append is one of level 0, and compact_due() merges a level that has reached its threshold into
one folder of the next, so each version is rewritten once for each level and never with the whole log.
"""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import layers, versions
from .files import Files

#: Bytes of Parquet in one partition of a rewrite.
TARGET_BYTES = 256 << 20
#: Seconds that a folder is kept after it has left the manifests, and that a staged or pinned one is kept at most.
GRACE, HOLD = 600.0, 86_400.0

#: One commit at a time in a driver: not every file system creates files atomically.
_COMMIT = threading.Lock()


class CommitConflict(RuntimeError):
    """Another commit was published first."""


class VersionStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys, self.files = spark, path.rstrip("/"), schema, list(keys), Files(spark)

    # manifests

    def _names(self) -> list[str]:
        return [n for n in self.files.names(f"{self.path}/_manifest") if n.endswith(".json")]

    def _parsed(self, name: str) -> dict | None:
        """A manifest file's contents; None if it is torn."""
        try:
            check, body = self.files.read(f"{self.path}/_manifest/{name}").split("\n", 1)
            return json.loads(body) if int(check) == zlib.crc32(body.encode()) else None
        except ValueError:
            return None

    def manifest(self) -> dict:
        """The newest readable manifest: version, folders (newest last), levels, retired (folder: time), applied (last batch)."""
        names = self._names()
        for name in reversed(names):
            if (found := self._parsed(name)) is not None:  # torn: the one before it counts
                return {"levels": {}, "retired": {}} | found | {"next": int(name.removesuffix(".json")) + 1}
        return {"version": 0, "folders": [], "levels": {}, "retired": {}, "applied": -1, "next": int(names[-1].removesuffix(".json")) + 1 if names else 1}

    def _publish(self, seen: dict, folders: list[str], applied: int | None = None, levels: dict[str, int] | None = None) -> int:
        with _COMMIT:
            return self._publish_locked(seen, folders, applied, levels or {})

    def _publish_locked(self, seen: dict, folders: list[str], applied: int | None, levels: dict[str, int]) -> int:
        # a torn newest manifest keeps its number; the next one follows it
        names = self._names()
        newest = int(names[-1].removesuffix(".json")) if names else 0
        if newest >= seen["next"] and self.manifest()["version"] != seen["version"]:
            raise CommitConflict(f"{self.path} has moved on from version {seen['version']}")
        number = max(newest + 1, seen["next"])
        level = {f: n for f, n in (seen["levels"] | levels).items() if f in folders and n}
        now = time.time()
        retired = {f: t for f, t in seen["retired"].items() if now - t < HOLD} | {f: now for f in seen["folders"] if f not in folders}
        body = json.dumps({"version": number, "folders": folders, "levels": level, "retired": retired, "applied": seen["applied"] if applied is None else applied})
        try:
            self.files.create(f"{self.path}/_manifest/{number:020d}.json", f"{zlib.crc32(body.encode())}\n{body}")
        except FileExistsError:
            raise CommitConflict(f"version {number} of {self.path} exists") from None
        for f in folders:
            if f not in seen["folders"]:
                self.files.delete(f"{self.path}/_held/{f}.staged")
        return number

    # reading

    def log(self, manifest: dict | None = None) -> DataFrame:
        """All versions. Key predicates reach the files: rows are sorted by key in each, with statistics and filters."""
        folders = (manifest or self.manifest())["folders"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def state(self, ts: versions.Stamp | None = None) -> DataFrame:
        """Live rows now, or as of a timestamp."""
        return versions.latest(self.log(), self.keys) if ts is None else versions.as_of(self.log(), self.keys, ts)

    # writing

    def _write(self, rows: DataFrame, folder: str) -> None:
        # vacuum() leaves a folder alone that carries this mark, until it is published
        self.files.create(f"{self.path}/_held/{folder}.staged", repr(time.time()))
        ordered = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields)).sortWithinPartitions(*self.keys, F.desc("wall"), F.desc("logical"))
        writer = ordered.write
        for k in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.path}/data/{folder}")

    def stage(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Writes rows that no reader sees yet: their folder, for publish() or discard(), and the rows read back."""
        folder = uuid.uuid4().hex
        self._write(rows, folder)
        return folder, self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}")

    def discard(self, folder: str) -> None:
        self.files.delete(f"{self.path}/data/{folder}")
        self.files.delete(f"{self.path}/_held/{folder}.staged")

    def publish(self, folder: str, applied: int | None = None, seen: dict | None = None) -> int:
        """Commits a staged folder and returns the store's version.

        With ``seen`` (an earlier manifest()) the commit fails if anything was committed since; without it a lost race
        is tried again, as appended rows do not depend on the state. ``applied`` marks the last applied batch.
        """
        for _ in range(20):
            base = seen or self.manifest()
            try:
                return self._publish(base, [*base["folders"], folder], applied)
            except CommitConflict:
                if seen:
                    self.discard(folder)
                    raise
        raise CommitConflict(f"{self.path}: other writers were faster 20 times")

    def append(self, rows: DataFrame, applied: int | None = None, seen: dict | None = None) -> int:
        """stage() and publish()."""
        return self.publish(self.stage(rows)[0], applied, seen)

    def _partitions(self, folders: list[str]) -> int:
        """Partitions of about TARGET_BYTES for the rows of some folders."""
        return max(1, math.ceil(sum(self.files.size(f"{self.path}/data/{f}") for f in folders) / TARGET_BYTES))

    def _merge(self, seen: dict, folders: list[str], change: Callable[[DataFrame], DataFrame], partitions: int | None, level: int) -> int:
        """Replaces ``folders`` by one with their changed rows, in key ranges."""
        made = uuid.uuid4().hex
        rows = change(self.log(seen | {"folders": folders}))
        self._write(rows.repartitionByRange(partitions or self._partitions(folders), *self.keys), made)
        kept = [f for f in seen["folders"] if f not in folders]
        try:
            return self._publish(seen, [made, *kept], levels={made: level})
        except CommitConflict:
            self.discard(made)
            raise

    def _top_level(self, seen: dict) -> int:
        return max([1, *seen["levels"].values()])

    def compact(self, partitions: int | None = None) -> int:
        """Merges all folders into one; no version is lost. Key ranges are sized by bytes unless ``partitions`` is given."""
        seen = self.manifest()
        return self._merge(seen, seen["folders"], lambda log: log, partitions, self._top_level(seen))

    def due(self, seen: dict | None = None) -> list[int]:
        """Levels that have as many folders as layers.level_threshold() names, lowest first."""
        seen = seen or self.manifest()
        found = [seen["levels"].get(f, 0) for f in seen["folders"]]
        return [k for k in sorted(set(found)) if found.count(k) >= layers.level_threshold(k)]

    def compact_due(self) -> int:
        """Merges each level that is due into one folder of the next; returns how many levels were merged."""
        merged = 0
        while ready := self.due(seen := self.manifest()):
            own = [f for f in seen["folders"] if seen["levels"].get(f, 0) == ready[0]]
            self._merge(seen, own, lambda log: log, None, ready[0] + 1)
            merged += 1
        return merged

    def collect_garbage(self, threshold: versions.Stamp, keep_visible: bool = False, partitions: int | None = None) -> int:
        """compact() that also drops the versions that gc_retained() drops."""
        seen = self.manifest()
        return self._merge(seen, seen["folders"], lambda log: versions.gc_retained(log, self.keys, threshold, keep_visible), partitions, self._top_level(seen))

    @contextmanager
    def pinned(self) -> Iterator[DataFrame]:
        """The log as of now; vacuum() keeps its folders while the block runs (HOLD seconds at most)."""
        seen, mark = self.manifest(), f"{self.path}/_held/{uuid.uuid4().hex}.pin"
        self.files.create(mark, "\n".join([repr(time.time()), *seen["folders"]]))
        try:
            yield self.log(seen)
        finally:
            self.files.delete(mark)

    def _held(self) -> set[str]:
        """Folders that are being staged or read under a pin."""
        out: set[str] = set()
        for name in self.files.names(f"{self.path}/_held"):
            try:
                since, *folders = self.files.read(f"{self.path}/_held/{name}").split("\n")
                fresh = time.time() - float(since) < HOLD
            except (FileNotFoundError, ValueError):
                fresh, folders = True, []  # being written or removed just now
            if fresh:
                out |= {name.removesuffix(".staged"), *folders}
        return out

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> list[str]:
        """Deletes folders that none of the last ``keep`` readable manifests names, and older manifests; returns the folders.

        Folders that are staged or pinned, or that left the manifests or were written less than ``grace`` seconds ago,
        stay. Where no manifest can be read nothing is deleted.
        """
        held = self._held()  # before the manifests: a folder published meanwhile is in one of the two
        names = self._names()
        readable = [(n, found) for n in reversed(names) if (found := self._parsed(n)) is not None][: max(1, keep)]
        if not readable:
            return []
        live = {f for _, found in readable for f in found["folders"]}
        retired = readable[0][1].get("retired", {})
        gone = []
        for f in self.files.names(f"{self.path}/data"):
            since = retired.get(f) or self.files.modified(f"{self.path}/data/{f}")
            if f not in live and f not in held and time.time() - since >= grace:
                self.files.delete(f"{self.path}/data/{f}")
                gone.append(f)
        for name in names:
            if name < readable[-1][0]:
                self.files.delete(f"{self.path}/_manifest/{name}")
        return gone

    # snapshots

    def export(self, path: str) -> None:
        """All versions as plain Parquet."""
        self.log().write.parquet(path)

    def restore(self, path: str) -> int:
        """Replaces everything by an export, in one commit."""
        seen, folder = self.manifest(), uuid.uuid4().hex
        self._write(self.spark.read.schema(self.schema).parquet(path), folder)
        return self._publish(seen, [folder], levels={folder: self._top_level(seen)})

    def clear(self) -> int:
        """An empty state, in one commit; vacuum() frees the files."""
        return self._publish(self.manifest(), [])
