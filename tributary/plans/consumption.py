"""Consumption of a bundle: a plan names the shards, a marker stands for each one read to its end, a receipt for all."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from tributary.plans.control import ControlError, artifact_id, publish_text
from tributary.sources import sinks

CONSUMERS = ("python", "torch", "generator")


def plan_consumption(spark: SparkSession, bundle: str, split: str, consumer: str, path: str) -> dict:
    """Record the shards of a split that a consumer will read, with their content."""
    if consumer not in CONSUMERS:
        raise ValueError(f"a consumer is one of {', '.join(CONSUMERS)}")
    shards = [r.asDict() for r in sinks.read_manifest(spark, bundle).where(f"split = '{split}'").orderBy("shard").select("split", "shard", "records", "file", "content_hash").collect()]  # bounded: a row a shard of one split
    if not shards:
        raise ControlError("EMPTY_SPLIT", split)
    body = {"bundle": bundle, "split": split, "consumer": consumer, "shards": shards}
    body["plan_id"] = artifact_id("consumption", body)
    publish_text(path, json.dumps(body, sort_keys=True))
    return body


class Consumption:
    """One run of a consumption plan; several workers may share its folder, and a run can be taken up again."""

    def __init__(self, spark: SparkSession, path: str, run_dir: str):
        self.spark, self.plan, self.run = spark, json.loads(Path(path).read_text()), Path(run_dir)
        publish_text(self.run / "plan.json", json.dumps(self.plan, sort_keys=True))
        (self.run / "shards").mkdir(exist_ok=True)

    def _marker(self, shard: dict) -> tuple[Path, str]:
        body = {"plan_id": self.plan["plan_id"], **{k: shard[k] for k in ("split", "shard", "records", "content_hash")}}
        return self.run / "shards" / f"{shard['shard']:05d}.json", json.dumps(body, sort_keys=True)

    def records(self, worker: int = 0, workers: int = 1) -> Iterator[dict]:
        """Records of every workers-th shard; a shard counts once its last record was taken."""
        if workers < 1 or not 0 <= worker < workers:
            raise ValueError("worker index and count are invalid")
        if self.receipt():
            raise ControlError("CONSUMPTION_COMPLETED", str(self.run))
        for place, shard in enumerate(self.plan["shards"]):
            if place % workers == worker:
                seen = 0
                for record in sinks.iter_shard(self.spark, self.plan["bundle"], shard["file"]):
                    seen += 1
                    yield record
                if seen != shard["records"]:
                    raise ControlError("SHARD_CHANGED", shard["file"])
                publish_text(*self._marker(shard))
        self.finish()

    def covered(self) -> list[int]:
        """Numbers of the shards read to their end."""
        return sorted(int(p.stem) for p in (self.run / "shards").glob("[0-9]*.json"))

    def finish(self) -> dict | None:
        """The receipt, once every shard of the plan has its marker; the same one however often it is asked for."""
        expected = dict(self._marker(s) for s in self.plan["shards"])
        there = set((self.run / "shards").glob("[0-9]*.json"))
        if there - set(expected):
            raise ControlError("CONSUMPTION_STATE", "a marker of no planned shard")
        if set(expected) - there:
            return None
        for path, text in expected.items():
            if path.read_text() != text:
                raise ControlError("CONSUMPTION_STATE", str(path))
        body = {"plan_id": self.plan["plan_id"], "split": self.plan["split"], "consumer": self.plan["consumer"], "shards": len(expected), "records": sum(s["records"] for s in self.plan["shards"])}
        body["receipt_id"] = artifact_id("consumed", body)
        publish_text(self.run / "receipt.json", json.dumps(body, sort_keys=True))
        return body

    def receipt(self) -> dict | None:
        path = self.run / "receipt.json"
        return json.loads(path.read_text()) if path.exists() else None
