"""Shared pieces of the operations: tables of keys to leave out, unions of labels, memory given back."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.graph import FEW, components, discard, keyed, materialize, merge_labels, pair_units
from tributary.session import shared_dir

__all__ = ["FEW", "components", "discard", "keyed", "materialize", "merge_labels", "pair_units", "quiet", "shared_dir", "without"]

def without(df: DataFrame, gone: DataFrame, keys: list[Column], tag: str) -> DataFrame:
    """Rows of df whose keys are not a row of gone (its columns in the order of keys; nulls are equal)."""
    gone = materialize(gone.toDF(*(f"_gone{k}" for k in range(len(keys)))).distinct(), tag)
    match = F.lit(True)
    for k, key in enumerate(keys):
        match = match & key.eqNullSafe(F.col(f"_gone{k}"))
    return df.join(F.broadcast(gone) if gone.count() <= FEW else gone, match, "left_anti")


@contextmanager
def quiet(collect: bool = True):
    """The body of a task in a reused worker: free memory goes back to the system at its end.

    collect=False: the garbage collector rests meanwhile (millions of small live
    objects without cycles would only be walked) and works again afterwards.
    """
    was = gc.isenabled()
    if not collect:
        gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library can
            pass
