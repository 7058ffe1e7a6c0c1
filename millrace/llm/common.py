"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, staged

__all__ = ["WS", "fits", "fresh_path", "map_arrow", "spread_join", "staged", "text_of"]

#: ASCII white space, as a regular-expression class body.
WS = r"\x20\x09-\x0D"
#: A key is hot if it has more than one in HOT_KEYS of all rows, so at most HOT_KEYS are; and more than FEW_ROWS.
HOT_KEYS, FEW_ROWS = 1_000, 50
_shipped: set[str] = set()


#: What a Python worker keeps between tasks, by operator.
kept: dict[str, object] = {}


def keep_only(operator: str) -> None:
    """Lets go of what this worker keeps for other operators."""
    for name in [n for n in kept if n != operator]:
        del kept[name]


def give_back() -> None:
    """Returns this worker's free memory to the system, as idle workers stay beside the executor's other tasks."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable, schema: str | object, operator: str = "") -> DataFrame:
    """df.mapInArrow(run, schema), with this package sent to the executors once.

    operator: the name under which run keeps things in `kept`; a worker has those of one operator at a time.
    """

    def alone(batches: Iterator) -> Iterator:
        keep_only(operator)
        yield from run(batches)
        give_back()

    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp()  # the driver serves the archive from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = shutil.make_archive(os.path.join(folder, "millrace_code"), "zip", root.parent, root.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df.mapInArrow(alone, schema)


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a staged frame has at most so many rows: the check before each explicit broadcast."""
    return df.count() <= rows


def spread_join(rows: DataFrame, known: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows.join(known, keys, how) with no hot key in one task. how: inner, left or left_semi.

    known is staged, has one row for each key and, in `weight`, the number of rows with that key. Hot keys, of which there
    can be HOT_KEYS at most, are broadcast, so their rows stay where they are; the rest is joined as Spark sees fit.
    """
    total, most = (x or 0 for x in known.agg(F.sum(weight), F.max(weight)).first())
    limit = max(FEW_ROWS, total // HOT_KEYS)
    hot = known.where(F.col(weight) > limit).drop(weight)
    if most <= limit:
        return rows.join(known.drop(weight), keys, how)
    near = rows.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner")
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return near.unionByName(far.join(known.where(F.col(weight) <= limit).drop(weight), keys, how))
