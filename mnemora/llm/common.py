"""Shared plumbing of the operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, components, shared_dir  # noqa: F401 - the operators take them from here

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hand_back() -> None:
    """Returns a worker's free memory to the system: workers outlive their tasks, and
    several stages' workers share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidied(run):
    """A function over batches that hands back memory when its task is done."""

    def tidy(batches):
        yield from run(batches)
        hand_back()

    return tidy


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learned from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
