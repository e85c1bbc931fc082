"""A workspace of one keyed table: changesets are staged, checked and sealed into revisions; any revision can be had back.

Tables lie as Parquet under objects, named by the digest of their rows, so equal
states are stored once; records of the control plane are small JSON files.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import inspect, records
from tributary.plans.control import ControlError, Revisions, artifact_id, locked, publish_text, table_id
from tributary.sources import sinks


class Workspace:
    """One table with an id field; create with init, open with the constructor."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        if not (self.root / "workspace.json").exists():
            raise ControlError("NO_WORKSPACE", root)
        self.id_field = json.loads((self.root / "workspace.json").read_text())["id_field"]
        self.revisions = Revisions(str(self.root / "revisions"))

    @classmethod
    def init(cls, spark: SparkSession, root: str, id_field: str) -> Workspace:
        publish_text(Path(root) / "workspace.json", json.dumps({"id_field": id_field}))
        return cls(spark, root)

    # ---- objects ----

    def put(self, df: DataFrame) -> str:
        """Store a table once; returns its name."""
        name = artifact_id("table", table_id(df))
        target = str(self.root / "objects" / name)
        if not sinks.exists(self.spark, target):
            sinks.publish(self.spark, lambda part: df.write.parquet(part), target)
        return name

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.root / "objects" / name))

    def materialize(self, revision: str | None = None) -> DataFrame:
        """The table of any reachable revision, of HEAD by default; rows are checked against their name."""
        revision = revision or self.revisions.head()
        if revision is None or revision not in self.revisions.reachable():
            raise ControlError("NO_REVISION", str(revision))
        name = self.revisions.show(revision)["content"]["table"]
        df = self.get(name)
        if artifact_id("table", table_id(df)) != name:
            raise ControlError("OBJECT_CHANGED", name)
        return df

    def export(self, target: str, revision: str | None = None) -> dict:
        """Write a revision as canonical JSONL."""
        return sinks.write_jsonl(self.materialize(revision), self.id_field, target)

    def status(self) -> dict:
        return {"head": self.revisions.head(), "changeset": self._open()}

    # ---- changesets ----

    def _open(self) -> dict | None:
        path = self.root / "CHANGESET"
        return json.loads(path.read_text()) if path.exists() else None

    def _keep(self, body: dict | None) -> None:
        path, part = self.root / "CHANGESET", self.root / "CHANGESET.part"
        if body is None:
            path.unlink(missing_ok=True)
            return
        part.write_text(json.dumps(body, sort_keys=True))
        os.replace(part, path)

    def _need(self, *keys: str) -> dict:
        body = self._open()
        if body is None or any(k not in body for k in keys):
            raise ControlError("CHANGESET_STATE", f"needs {', '.join(keys) or 'an open changeset'}")
        return body

    def begin(self, message: str) -> dict:
        """Open the one changeset, on the HEAD seen now."""
        with locked(self.root):
            if self._open():
                raise ControlError("CHANGESET_OPEN", self._open()["message"])
            body = {"base": self.revisions.head(), "message": message}
            self._keep(body)
        return body

    def abandon(self) -> None:
        self._keep(None)

    def stage(self, df: DataFrame) -> dict:
        """Store a candidate; an earlier check no longer counts."""
        body = self._need()
        sinks.check_fields(df, self.id_field)
        body = {"base": body["base"], "message": body["message"], "table": self.put(df)}
        self._keep(body)
        return body

    def check(self, rules: dict | None = None, mode: str = "full") -> DataFrame:
        """Findings of the staged table against its base; the changeset remembers whether it passed."""
        body = self._need("table")
        after = self.get(body["table"])
        before = self.materialize(body["base"]) if body["base"] else None
        facts = inspect.tabular_health(after, self.id_field).withColumn("invalid_records", F.lit(0).cast("bigint"))
        found = inspect.review_records(before, after, self.id_field, rules, mode, facts=facts)
        body["check"] = {"status": inspect.status(found), "mode": mode}
        self._keep(body)
        return found

    def seal(self) -> str:
        """Make the checked, passed candidate the new HEAD."""
        body = self._need("table", "check")
        if body["check"]["status"] != "pass":
            raise ControlError("CHECK_FAILED", body["message"])
        revision = self.revisions.commit({"table": body["table"], "check": body["check"]}, body["message"], body["base"])
        self._keep(None)
        return revision

    # ---- patches ----

    def patch(self, rid: str, field: str, value, expected) -> dict:
        """Stage HEAD with one field of one record set (None removes it), where it still holds the expected value; undo with the returned record."""
        self._need()
        df = self.get(self._need()["table"]) if "table" in self._need() else self.materialize()
        hit = F.col(self.id_field).cast("string") == rid
        seen = df.where(hit).select(F.col(f"`{field}`")).limit(2).collect()
        if len(seen) != 1 or seen[0][0] != expected:
            raise ControlError("PREIMAGE", f"{rid}.{field} is not {expected!r}")
        self.stage(records.patch(df, self.id_field, rid, field, expected, value))
        return {"rid": rid, "field": field, "before": expected, "after": value}

    def undo(self, done: dict) -> dict:
        """Stage the opposite of a patch."""
        return self.patch(done["rid"], done["field"], done["before"], done["after"])

    # ---- housekeeping ----

    def gc(self, dry: bool = True) -> list[str]:
        """Objects that no reachable revision and no open changeset names; removed unless dry."""
        held = {self.revisions.show(r)["content"]["table"] for r in self.revisions.reachable()}
        held |= {self._open().get("table")} if self._open() else set()
        folder = self.root / "objects"
        gone = sorted(p.name for p in folder.iterdir() if p.name not in held) if folder.exists() else []
        for name in [] if dry else gone:
            fs, path = sinks._path(self.spark, str(folder / name))
            fs.delete(path, True)
        return gone
