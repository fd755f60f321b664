"""Versioned publication of artifact builds: publish, promote, roll back, verify, retain, migrate.

Artifacts are parquet tables under ``<root>/builds/<build>/<artifact>``; the small state (builds and which one is
active) is a JSON file of its own for each change, so that a crash never loses it. Only names and checksums pass through the driver.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Migration = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def checksum(table: DataFrame) -> tuple[int, str]:
    """Rows and an order-free checksum of a table: the sum of row hashes, wrapped by modulus."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(table.columns)])
    n, total = table.agg(F.count("*"), F.sum(F.pmod(row, F.lit(2**31 - 1)))).first()
    return n, f"{total or 0:x}"


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _states(self) -> list[str]:
        root = self._path("")
        found = [f.getPath().getName() for f in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return sorted(n for n in found if n.startswith("state-") and n.endswith(".json"))

    def _load(self) -> dict:
        names = self._states()
        if not names:
            return {"active": None, "builds": {}}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/{names[-1]}").collect()))

    def _store(self, state: dict) -> None:
        """Writes the next numbered state aside and renames it into place; the one before stays until then."""
        names = self._states()
        number = int(names[-1][6:-5]) + 1 if names else 1
        out = self.fs.create(self._path("_next"), True)
        out.write(bytearray(json.dumps(state, sort_keys=True), "utf-8"))
        out.close()
        if not self.fs.rename(self._path("_next"), self._path(f"state-{number:09d}.json")):
            raise OSError(f"state {number} was not stored")
        for old in names[:-1]:
            self.fs.delete(self._path(old), False)

    def publish(self, build: str, artifacts: dict[str, DataFrame], version: str = "1.0.0") -> dict:
        """Writes a build and its manifest; a build is written once."""
        state = self._load()
        if build in state["builds"]:
            raise ValueError(f"build {build} exists")
        manifest = {}
        for name, table in sorted(artifacts.items()):
            where = f"{self.root}/builds/{build}/{name}"
            table.write.parquet(where)
            rows, digest = checksum(self.spark.read.parquet(where))
            manifest[name] = {"rows": rows, "checksum": digest}
        state["builds"][build] = {"state": "published", "version": version, "at": datetime.now(timezone.utc).isoformat(), "artifacts": manifest}
        self._store(state)
        return state["builds"][build]

    def promote(self, build: str) -> None:
        """Makes a build the active one; the former becomes deprecated."""
        state = self._load()
        if build not in state["builds"]:
            raise KeyError(build)
        if former := state["active"]:
            state["builds"][former]["state"] = "deprecated"
            state["builds"][former]["deprecated_at"] = datetime.now(timezone.utc).isoformat()
        state["previous"], state["active"] = state["active"], build
        state["builds"][build]["state"] = "active"
        self._store(state)

    def rollback(self) -> str:
        """Makes the build before the active one active again."""
        state = self._load()
        if not state.get("previous"):
            raise ValueError("nothing to roll back to")
        back = state["previous"]
        self.promote(back)
        return back

    def resolve(self, artifact: str, build: str | None = None) -> DataFrame:
        """The artifact of a build, of the active one by default."""
        build = build or self._load()["active"]
        if build is None:
            raise ValueError("no active build")
        return self.spark.read.parquet(f"{self.root}/builds/{build}/{artifact}")

    def verify(self, build: str) -> list[str]:
        """Artifacts whose content differs from the manifest."""
        manifest = self._load()["builds"][build]["artifacts"]
        return [n for n, m in manifest.items() if checksum(self.resolve(n, build)) != (m["rows"], m["checksum"])]

    def builds(self) -> dict:
        return self._load()["builds"]

    def active(self) -> str | None:
        return self._load()["active"]

    def retain(self, keep: int = 5, days: int = 30, now: datetime | None = None) -> dict[str, list[str]]:
        """Archives deprecated builds beyond the newest ``keep`` (one at least), purges those archived more than ``days`` ago.

        Neither the active build nor the one a rollback would make active is ever touched.
        """
        state, now = self._load(), now or datetime.now(timezone.utc)
        safe, builds = {state["active"], state.get("previous")}, state["builds"]
        old = sorted((b for b, s in builds.items() if s["state"] == "deprecated" and b != state["active"]), key=lambda b: builds[b]["deprecated_at"])
        archived = [b for b in old[: max(len(old) - max(keep, 1), 0)] if b not in safe]
        for b in archived:
            builds[b].update(state="archived", archived_at=now.isoformat())
        purged = [b for b, s in builds.items() if s["state"] == "archived" and b not in safe and now - datetime.fromisoformat(s["archived_at"]) > timedelta(days=days)]
        for b in purged:
            del builds[b]
        self._store(state)
        for b in purged:  # after the state has forgotten them
            self.fs.delete(self._path(f"builds/{b}"), True)
        return {"archived": archived, "purged": purged}


class Migrations:
    """Transforms between contract versions; a path is the shortest chain of registered steps."""

    def __init__(self) -> None:
        self.steps: dict[str, dict[str, Migration]] = {}

    def register(self, start: str, end: str, step: Migration) -> None:
        self.steps.setdefault(start, {})[end] = step

    def path(self, start: str, end: str) -> list[str]:
        queue, seen = deque([[start]]), {start}
        while queue:
            way = queue.popleft()
            if way[-1] == end:
                return way
            for nxt in sorted(self.steps.get(way[-1], {})):
                if nxt not in seen:
                    seen.add(nxt)
                    queue.append([*way, nxt])
        raise KeyError(f"no way from {start} to {end}")

    def apply(self, artifacts: dict[str, DataFrame], start: str, end: str) -> dict[str, DataFrame]:
        way = self.path(start, end)
        for a, b in zip(way, way[1:]):
            artifacts = self.steps[a][b](artifacts)
        return artifacts
