"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import ensure_checkpoint_dir, written_table
from ..functions.text import let

__all__ = ["ascii_lower", "ensure_checkpoint_dir", "let", "only_tables_of", "pick", "read", "ship", "spaced_words", "written_table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six white-space characters of the contracts: space and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"

_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that further columns of the caller cannot clash with helper columns."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other letter stays.  Pure ASCII texts take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced_words(text: Column) -> Column:
    """Maximal runs of characters other than the six white-space characters."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have the repository on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sylvan_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


_tables: dict[str, Callable[[], None]] = {}


def only_tables_of(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called as a task begins in a Python worker: forget the tables that other operators left in it.

    Workers outlive their tasks and serve all stages of a session, so tables of several operators
    would add up.  ``clear`` forgets the tables that ``owner`` is about to build.
    """
    others = [n for n in _tables if n != owner]
    for n in others:
        _tables.pop(n)()
    if others:
        gc.collect()
    if clear:
        _tables[owner] = clear
