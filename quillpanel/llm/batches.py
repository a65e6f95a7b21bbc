"""Arrow batches in small slices, so that a task holds a bounded part of its rows as Python objects."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_ROWS = 512
SLICE_BYTES = 4 << 20
#: Rows and bytes of the batches that executors send to Python workers: each is held on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def amount(setting: str) -> int:
    """A setting's number, with a unit of bytes such as ``64m`` or ``8kb`` or without one."""
    digits = setting.strip().lower().rstrip("bkmgtpi")
    unit = setting.strip().lower()[len(digits) :][:1]
    return int(digits) << 10 * "bkmgtp".index(unit or "b")


def in_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session sends Python workers no larger batches than BATCH from now on; a smaller setting stays."""
    conf = docs.sparkSession.conf
    for name, most in BATCH.items():
        if not 0 < amount(conf.get(name)) <= most:
            conf.set(name, str(most))
    return docs


def worker_tables() -> dict:
    """What this Python worker keeps from task to task, by (kind, ...)."""
    return sys.modules.setdefault("_quillpanel_worker", types.ModuleType("_quillpanel_worker")).__dict__


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes; a larger single row is a slice of its own.

    Tables that tasks of other operators left in this worker go; those of the kind ``keep`` stay.
    """
    tables = worker_tables()
    for name in [k for k in tables if isinstance(k, tuple) and k[0] != keep]:
        del tables[name]
    pa.default_memory_pool().release_unused()
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and _size(batch, at, n) > most:
                n //= 2
            yield batch.slice(at, n)
            at += n


def _size(batch: pa.RecordBatch, at: int, n: int) -> int:
    return batch.slice(at, n).nbytes


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def utf8(texts: list[str | None]) -> list[bytes]:
    """Texts as UTF-8; a null text is an empty one."""
    return [b"" if t is None else t.encode() for t in texts]


def quoted(name: str) -> str:
    """``name`` as one column, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, *taken: str) -> str:
    """``name``, or with as many signs before it as keep it apart from ``taken``, whose case does not count."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
