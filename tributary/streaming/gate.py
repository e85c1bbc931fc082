"""A quality gate over a stream: each micro-batch's violations are rolled up and kept or refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tributary.operators.policy import roll_up, violations


def gate(stream: DataFrame, id_col: str, rules: dict, accept: Callable[[DataFrame, int], None], refuse: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands sound batches to accept and the findings of others to refuse."""

    def run(batch: DataFrame, epoch: int) -> None:
        found = roll_up(violations(batch, id_col, rules))
        if found.isEmpty():
            accept(batch, epoch)
        else:
            refuse(found, epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
