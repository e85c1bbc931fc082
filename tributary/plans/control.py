"""Plan, accept, apply: what runs is what was reviewed. Thin driver-side records over DataFrame plans."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.sources import sinks


class ControlError(RuntimeError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def artifact_id(prefix: str, body: dict) -> str:
    """prefix_ and a digest of the canonical JSON of body."""
    return f"{prefix}_{hashlib.sha256((prefix + chr(0) + json.dumps(body, sort_keys=True, separators=(',', ':'))).encode()).hexdigest()}"


def table_id(df: DataFrame) -> dict:
    """Identity of a table's rows that no partitioning or order changes: count and two sums over row hashes."""
    names = sorted(df.columns)
    h = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in names))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("s"), F.bit_xor(h).alias("x")).first()
    return {"columns": names, "rows": row["n"], "sum": row["s"], "xor": row["x"]}


def publish_text(path: str | Path, text: str) -> None:
    """Publish a record once, whole or not at all: the same text again is fine, another one is not."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(text)
    try:
        os.link(part, path)  # fails where path exists, whoever was first
    except FileExistsError:
        if path.read_text() != text:
            raise ControlError("EXISTS", str(path)) from None
    finally:
        part.unlink()


def _write_new(path: Path, body: dict) -> None:
    publish_text(path, json.dumps(body, sort_keys=True, indent=1))


@contextmanager
def locked(root: Path):
    """One writer at a time below root: a lock file that only one can create."""
    path = root / "LOCK"
    try:
        os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError:
        raise ControlError("LOCKED", str(path)) from None
    try:
        yield
    finally:
        path.unlink()


def plan(df: DataFrame, spec: dict, path: str) -> dict:
    """Record what a spec gives, without writing rows."""
    body = {"spec": spec, "result": table_id(df)}
    body["plan_id"] = artifact_id("plan", body)
    _write_new(Path(path), body)
    return body


def apply(df: DataFrame, path: str, accept: str, output: str) -> dict:
    """Write rows as Parquet if they are still what the accepted plan recorded; returns the receipt."""
    body = json.loads(Path(path).read_text())
    if accept != body["plan_id"]:
        raise ControlError("PLAN_NOT_ACCEPTED", accept)
    if table_id(df) != body["result"]:
        raise ControlError("RESULT_CHANGED", "the inputs are not those of the plan")
    receipt = {"plan_id": accept, "output": output, "result": body["result"]}
    receipt["receipt_id"] = artifact_id("receipt", receipt)
    spark = df.sparkSession
    if not sinks.exists(spark, output):
        sinks.publish(spark, lambda part: df.write.parquet(part), output)
    elif table_id(spark.read.parquet(output)) != body["result"]:
        raise ControlError("OUTPUT_EXISTS", output)
    _write_new(Path(f"{path}.receipt"), receipt)
    return receipt


def receipt(path: str) -> dict:
    """The receipt of an applied plan."""
    found = Path(f"{path}.receipt")
    if not found.exists():
        raise ControlError("NOT_APPLIED", path)
    return json.loads(found.read_text())


class Revisions:
    """Parent-linked immutable revisions; HEAD moves only from the revision that the writer saw."""

    def __init__(self, root: str):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def head(self) -> str | None:
        path = self.root / "HEAD"
        return path.read_text() or None if path.exists() else None

    def commit(self, content: dict, message: str, expected: str | None) -> str:
        body = {"parent": expected, "content": content, "message": message}
        rev = artifact_id("rev", body)
        with locked(self.root):  # comparing and moving HEAD are one step
            if self.head() != expected:
                raise ControlError("HEAD_MOVED", f"{self.head()} is not {expected}")
            _write_new(self.root / f"{rev}.json", body)
            part = self.root / "HEAD.part"
            part.write_text(rev)
            os.replace(part, self.root / "HEAD")
        return rev

    def show(self, revision: str) -> dict:
        path = self.root / f"{revision}.json"
        if not path.exists():
            raise ControlError("NO_REVISION", revision)
        return json.loads(path.read_text())

    def reachable(self) -> list[str]:
        out, at = [], self.head()
        while at:
            out.append(at)
            at = self.show(at)["parent"]
        return out

    def log(self, offset: int = 0, limit: int = 50) -> list[dict]:
        out, at = [], self.head()
        while at and len(out) < offset + limit:
            body = json.loads((self.root / f"{at}.json").read_text())
            out.append({"revision": at, **body})
            at = body["parent"]
        return out[offset:]


def lineage(paths: list[str]) -> list[dict]:
    """Plans and their receipts, in order of the given records."""
    out = []
    for p in paths:
        body = json.loads(Path(p).read_text())
        done = Path(f"{p}.receipt")
        out.append({"plan_id": body["plan_id"], "receipt_id": json.loads(done.read_text())["receipt_id"] if done.exists() else None})
    return out
