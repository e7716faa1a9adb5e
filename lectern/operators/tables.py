"""Tables of an archive: rows by folder, dealt into buckets, changed by small writes.

A change is a delta: for the folders it names, all their rows from now on (none, for folders that are gone). A bucket is
a base and the deltas since; a reader takes each folder's rows from the newest part that names it. Deltas are merged
among themselves when they are many, and into the base when together they are a fair part of it, so that a row is
rewritten a bounded number of times while the table doubles, and a small change writes little whatever lies there.
As the table grows, buckets are split one by one, each into two (linear hashing): a bucket's size stays bounded.

What is valid is told by numbered commits, each created only if no other writer has. A writer that finds its number
taken goes on with the next if the other's commit touches none of its buckets, and otherwise has to decide anew. A commit
names changes only; from time to time the whole state is written beside it. Files that no state names are removed
after a while.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.files import Files

#: Deltas of a bucket before they are merged; the part of a base that they may reach before it is rewritten.
DELTAS, PART = 8, 0.25
#: Bytes of a bucket of the largest table, on average, before buckets are split.
SPLIT = 128 << 20
#: Commits between two writings of the whole state.
STATES = 16
#: Columns beside a table's own: the commit that a row came with, and whether it only says that the folder is gone.
SEQ, GONE = "commit_seq", "folder_gone"


class Conflict(Exception):
    """Another writer has changed what a commit rests on."""


@dataclass
class Part:
    version: str
    bytes: int
    base: bool


def _empty() -> dict:
    return {"number": 0, "config": {}, "tables": {}, "segments": {}, "facts": {}}


def applied(state: dict, commit: dict) -> None:
    """The state after a commit."""
    for name, buckets in commit.get("tables", {}).items():
        table = state["tables"].setdefault(name, {})
        for bucket, change in buckets.items():
            kept = [p for p in table.get(bucket, []) if p[0] not in change["drop"]]
            table[bucket] = sorted(kept + change["add"], key=lambda p: not p[2])  # the base first
            if not table[bucket]:
                del table[bucket]
    for name, change in commit.get("segments", {}).items():
        kept = [s for s in state["segments"].get(name, []) if s["version"] not in change["drop"]]
        state["segments"][name] = sorted(kept + change["add"], key=lambda s: s["seq"])
    for name, more in commit.get("facts", {}).items():
        state["facts"][name] = [a + b for a, b in zip(state["facts"].get(name, [0] * len(more)), more)]
    state["config"].update(commit.get("config", {}))
    state["number"] = commit["number"]


@dataclass
class Tables:
    """Tables with the columns that ``schemas`` gives. Rows are dealt into buckets by the first of a table's ``keys``, and a
    delta replaces the rows that agree in all of them: ``folder_name``, where there is nothing else."""

    spark: SparkSession
    path: str
    schemas: dict[str, str]
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    state: dict = field(default_factory=_empty)
    staged: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.files = Files(self.spark, self.path)

    # Commits.

    def load(self) -> bool:
        """Takes over the newest state; False if there is none."""
        states = sorted(e.name for e in self.files.list("states") if e.name.endswith(".json") and not e.name.startswith("."))
        self.state = json.loads(self.files.read(f"states/{states[-1]}")) if states else _empty()
        self.staged = {}
        for name in sorted(e.name for e in self.files.list("commits") if e.name.endswith(".json") and not e.name.startswith(".")):
            if int(name.split(".")[0]) == self.state["number"] + 1:
                applied(self.state, json.loads(self.files.read(f"commits/{name}")))
        return self.state["number"] > 0

    def commit(self, config: dict[str, str] | None = None) -> int:
        """Makes what is staged valid; returns the commit's number. Raises Conflict if another commit since touched the
        same buckets or segments, or set any of ``config`` to something else; nothing is valid then."""
        change = {"tables": {}, "segments": {}, "facts": {}} | self.staged | {"config": config or {}}
        while True:
            number = self.state["number"] + 1
            told = json.dumps(change | {"number": number}).encode()
            if self.files.create(f"commits/{number:020}.json", told):
                applied(self.state, json.loads(told))
                self.staged = {}
                if number % STATES == 0:
                    self.files.create(f"states/{number:020}.json", json.dumps(self.state).encode())
                return number
            other = json.loads(self.files.read(f"commits/{number:020}.json"))
            if self._overlaps(change, other):
                raise Conflict(f"commit {number} touches the same rows")
            applied(self.state, other)

    def _overlaps(self, mine: dict, other: dict) -> bool:
        by_row = mine["tables"] or mine["segments"]
        if by_row and (other["config"].keys() & {"buckets"} or any(mine["config"].get(k, v) != v for k, v in other["config"].items() if k not in NOTES)):
            return True
        if any(mine["tables"].get(name, {}).keys() & buckets.keys() for name, buckets in other["tables"].items()):
            return True
        return any(set(mine["segments"].get(name, {}).get("drop", [])) & set(change["drop"]) for name, change in other["segments"].items())

    # Buckets.

    @property
    def buckets(self) -> int:
        return int(self.state["config"]["buckets"])

    @property
    def rounds(self) -> int:
        """The largest number of buckets at which all were split alike, up to now."""
        n = int(self.state["config"]["first_buckets"])
        while 2 * n <= self.buckets:
            n *= 2
        return n

    def _keys(self, name: str) -> tuple[str, ...]:
        return self.keys.get(name, ("folder_name",))

    def bucket(self, folder: Column | str = "folder_name", buckets: int | None = None) -> Column:
        column = (F.col(folder) if isinstance(folder, str) else folder).cast("binary")
        n, h = self.buckets if buckets is None else buckets, F.crc32(column)
        whole = self.rounds
        return (h % whole if n == whole else F.when(h % (2 * whole) < n, h % (2 * whole)).otherwise(h % whole)).cast("int")

    def parts(self, name: str) -> dict[int, list[Part]]:
        return {int(b): [Part(*p) for p in parts] for b, parts in self.state["tables"].get(name, {}).items()}

    def _files_of(self, name: str, chosen: Iterable[tuple[int, Part]]) -> DataFrame:
        schema = f"{self.schemas[name]}, {SEQ} long, {GONE} boolean"
        paths = [f"{self.path}/{name}/{p.version}/bucket={b}" for b, p in chosen]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def newest(self, name: str, buckets: Iterable[int] | None = None, deltas_only: bool = False) -> DataFrame:
        """The table's rows with SEQ and GONE: for each folder those of the newest part that names it.

        Bases and deltas are read apart, so that a table without deltas is read as it is.
        """
        wanted = None if buckets is None else set(buckets)
        held = [(b, p) for b, parts in sorted(self.parts(name).items()) if wanted is None or b in wanted for p in parts]
        bases = self._files_of(name, [(b, p) for b, p in held if p.base and not deltas_only])
        deltas = [(b, p) for b, p in held if not p.base]
        if not deltas:
            return bases
        changed = self._files_of(name, deltas)
        keys = list(self._keys(name))
        latest = changed.groupBy(*keys).agg(F.max(SEQ).alias(SEQ))
        named = changed.join(latest, [*keys, SEQ], "left_semi").select(changed.columns)
        return named if deltas_only else bases.join(latest, keys, "left_anti").select(changed.columns).unionByName(named)

    def table(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        return self.newest(name, buckets).filter(~F.col(GONE)).drop(SEQ, GONE)

    # Changes.

    def _write(self, name: str, rows: DataFrame, order: Iterable[str], buckets: int | None = None) -> tuple[str, dict[int, int]]:
        """A version of some buckets' rows: its name, and the bytes of each bucket that has any."""
        version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        columns = [c.split()[0] for c in self.schemas[name].split(", ")]
        key = self._keys(name)[0]
        dealt = rows.select(*columns, SEQ, GONE).withColumn("bucket", self.bucket(key, buckets)).repartition("bucket", F.pmod(F.xxhash64(*self._keys(name)), F.lit(4)))
        dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.path}/{name}/{version}")
        there = [int(e.name.partition("=")[2]) for e in self.files.list(f"{name}/{version}") if e.name.startswith("bucket=")]
        return version, {b: self.files.size(f"{name}/{version}/bucket={b}") for b in there}

    def _stage(self, name: str, changes: dict[int, dict]) -> None:
        held = self.staged.setdefault("tables", {}).setdefault(name, {})
        for b, change in changes.items():
            if str(b) in held:
                raise ValueError(f"bucket {b} of {name} is changed twice in a commit")
            held[str(b)] = change

    def put(self, name: str, rows: DataFrame, gone: DataFrame | None = None, order: Iterable[str] | None = None) -> list[int]:
        """Stages all rows of the keys that occur in ``rows``, and that the folders in ``gone`` have none (for tables by
        folder); returns the buckets that this touches."""
        columns = [c.split()[0] for c in self.schemas[name].split(", ")]
        seq = F.lit(self.state["number"] + 1).cast("long").alias(SEQ)
        named = rows.select(*columns, seq, F.lit(False).alias(GONE))
        if gone is not None:
            types = dict(self.spark.createDataFrame([], self.schemas[name]).dtypes)
            nothing = [F.col(c) if c == "folder_name" else F.lit(None).cast(types[c]).alias(c) for c in columns]
            named = named.unionByName(gone.select("folder_name").distinct().select(*nothing, seq, F.lit(True).alias(GONE)))
        version, sizes = self._write(name, named, order or self._keys(name))
        parts = self.parts(name)
        self._stage(name, {b: {"drop": [], "add": [[version, size, not parts.get(b)]]} for b, size in sizes.items()})
        return sorted(sizes)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Stages a whole new table."""
        named = rows.withColumns({SEQ: F.lit(self.state["number"] + 1).cast("long"), GONE: F.lit(False)})
        version, sizes = self._write(name, named, self._keys(name))
        parts = self.parts(name)
        self._stage(name, {b: {"drop": [p.version for p in parts.get(b, [])], "add": [[version, sizes[b], True]] if b in sizes else []} for b in sizes.keys() | parts.keys()})

    # Upkeep.

    def _merge(self, name: str, buckets: list[int], whole: bool, splitting: int | None = None) -> None:
        """Stages one part in place of several in each of ``buckets``: a base, if ``whole``, else a delta."""
        parts = self.parts(name)
        rows = self.newest(name, buckets, deltas_only=not whole)
        rows = rows.filter(~F.col(GONE)) if whole else rows
        version, sizes = self._write(name, rows, self._keys(name), splitting)
        old = {b: [p.version for p in parts[b] if whole or not p.base] for b in buckets}
        self._stage(name, {b: {"drop": old.get(b, []), "add": [[version, sizes[b], whole]] if b in sizes else []} for b in sizes.keys() | old.keys()})

    def compact(self) -> int:
        """Merges deltas where there are many, and splits buckets that have grown; returns how many buckets were written.

        Nothing is lost if another writer comes between: then this is left to a later call.
        """
        written = 0
        for name in self.schemas:
            bases, deltas = [], []
            for b, parts in self.parts(name).items():
                small, large = sum(p.bytes for p in parts if not p.base), sum(p.bytes for p in parts if p.base)
                if len(parts) > 1 and len([p for p in parts if not p.base]) >= DELTAS:
                    (bases if small >= PART * large else deltas).append(b)
            for buckets, whole in ((bases, True), (deltas, False)):
                if buckets:
                    self._merge(name, buckets, whole)
                    written += len(buckets)
        try:
            if written:
                self.commit()
            largest = max((sum(p.bytes for parts in self.parts(name).values() for p in parts) for name in self.schemas), default=0)
            wanted = min(2 * self.rounds, -(-largest // SPLIT))
            if wanted > self.buckets:
                written += self.split(wanted)
        except Conflict:
            self.load()
            return 0
        return written

    def split(self, buckets: int) -> int:
        """Splits as many buckets in two as make ``buckets`` of them; returns how many. Only those are rewritten."""
        whole = self.rounds
        if not self.buckets < buckets <= 2 * whole:
            raise ValueError(f"{self.buckets} buckets can't become {buckets}")
        halved = [b - whole for b in range(self.buckets, buckets)]
        for name in self.schemas:
            there = [b for b in halved if b in self.parts(name)]
            if there:
                self._merge(name, there, True, buckets)
        self.commit({"buckets": str(buckets)})
        return len(halved)

    def vacuum(self, older_than: float = 3600.0) -> int:
        """Removes versions that the newest state doesn't name, written over ``older_than`` seconds ago (readers may hold
        newer ones), and commits that a state has taken up; returns how many versions."""
        removed, until = 0, time.time() - older_than
        staged = self.staged.get("tables", {})
        for name in self.schemas:
            named = {p[0] for parts in self.state["tables"].get(name, {}).values() for p in parts} | {p[0] for c in staged.get(name, {}).values() for p in c["add"]}
            removed += self._remove(name, named, until)
        for name, segments in self.state["segments"].items():
            removed += self._remove(name, {s["version"] for s in segments} | {s["version"] for s in self.staged.get("segments", {}).get(name, {}).get("add", [])}, until)
        states = sorted(e.name for e in self.files.list("states") if e.name.endswith(".json") and e.changed < until)
        if states:
            for folder in ("states", "commits"):
                for e in self.files.list(folder):
                    if e.changed < until and (e.name < states[-1] or folder == "commits" and e.name == states[-1]):
                        self.files.delete(f"{folder}/{e.name}")
        return removed

    def _remove(self, name: str, named: set[str], until: float) -> int:
        old = [e.name for e in self.files.list(name) if e.name not in named and int(e.name[1:].partition("-")[0]) < until * 1e9]
        for version in old:
            self.files.delete(f"{name}/{version}")
        return len(old)


#: Settings that only tell what happened; writers that differ in them don't contradict each other.
NOTES = frozenset({"last_sync_finished_at", "last_sync_error"})
