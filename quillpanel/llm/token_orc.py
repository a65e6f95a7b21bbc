"""Token ids as ORC: encode, write in document order, read back by stripe or by document id.

ORC stores the id arrays and all counters with integer run-length encoding; each stripe carries a row
index with minima and maxima and a Bloom filter on ``doc_id``, so that a reader takes whole stripes in
parallel, skips stripes by their statistics, and finds single documents without reading the others' ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel.llm.batches import slices
from quillpanel.llm.encoding import ENCODED_BYTES, ENCODED_ROWS, ENCODER, END_ID, worker_encoder
from quillpanel.session import new_path

STRIPE_BYTES = 32 << 20
INDEX_ROWS = 1000
BLOOM_FPP = 0.01

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _encoder(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = worker_encoder(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, ENCODED_ROWS, ENCODED_BYTES, keep=ENCODER):
            ids, at = encoder.encode_all(batch.column(batch.schema.get_field_index("text")))
            n = np.diff(at) + 1
            before = np.concatenate([[0], np.cumsum(n)])
            values = pa.array(np.insert(ids, at[1:], end_id).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(start + before[:-1]),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), values),
                ],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            start += int(before[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write ids to ``path`` in ascending ``doc_id`` order.

    A null text is empty: its ids are the end id alone.  Rows with a null doc_id come first, rows with
    equal doc_ids are ordered by a hash of the text; other columns are ignored.  An empty table gives an
    empty folder of the same schema.  The texts move once, to ranges of doc_id; file k holds range k.
    """
    # The range also covers the text's hash, so that a doc_id repeated very often can be split.
    order = ["doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))]
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_encoder(tokenizer, end_id), FILE_SCHEMA).write.options(
        **{
            "compression": "zstd",
            "orc.create.index": "true",
            "orc.row.index.stride": str(INDEX_ROWS),
            "orc.stripe.size": str(STRIPE_BYTES),
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": str(BLOOM_FPP),
        }
    ).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Documents of ``write_tokens``: doc_id, start (ids of all documents before), n_tokens, ids.

    ``ids`` asks for single documents: the filter reaches the stripes' statistics and Bloom filters.
    """
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    # One row per written range; only the counters are read for it.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.col("part"), F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("part_base"))
    rows = files if ids is None else files.where(F.col("doc_id").isin(ids))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("part_base") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                batch.column(batch.schema.get_field_index("start")),
                pa.array(np.diff(at).astype(np.int64)),
                pa.array(np.array(crc, np.int64)),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(tokens: DataFrame) -> DataFrame:
    """Per document of ``read_tokens`` the checksum of its ids as they were read."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(
        _digests, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a new folder below the shared one and digest what is read back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digests(read_tokens(spark, path))
