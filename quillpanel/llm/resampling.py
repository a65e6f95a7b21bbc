"""Importance resampling towards a target text: documents that look like the target are drawn more often.

Every run of words of a text is a feature, hashed into a fixed number of buckets.  Two passes over the
texts: the first counts buckets (each task adds up an array and returns its non-zero cells), the second
scores documents with the array of the buckets' log-likelihood gains, which tasks hold (its length is the
number of buckets, whatever the data).  A Gumbel number of each document's id turns weights into a
draw without replacement: the highest scores win.

Scores are stored once.  The cutoff is found by bisection: jobs that only count how many stored scores
lie above the middles of what is left of the interval, first by score, then by document id among the
rows that tie at the cutoff.  The drawn rows are partitioned by range and sorted there, and a row's rank
is its place plus the rows of the partitions before its own, so that no task holds more than a range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel.llm.batches import column, slices, utf8
from quillpanel.session import stage

BUCKETS = 10_000
LONGEST_RUN = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Levels of the bisection that one count job settles, by counting at 2**LEVELS - 1 middles.
LEVELS = 5
#: A text is read in windows of this many bytes; words up to KEPT_BYTES are kept, at most KEPT_WORDS a task.
WINDOW, KEPT_BYTES, KEPT_WORDS = 1 << 18, 48, 200_000


def word_table() -> bytes:
    """Lower-cases A-Z and turns every byte that separates words (00-2F, 3A-60, 7B-7F) into a blank."""
    table = bytearray(range(256))
    for b in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]:
        table[b] = b + 32 if 0x41 <= b <= 0x5A else 0x20
    return bytes(table)


class Features:
    """Buckets of the features of UTF-8 texts; remembers the buckets of short single words."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.table, self.kept = buckets, longest, word_table(), {}

    def _single(self, words: list[bytes]) -> np.ndarray:
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        found = list(map(self.kept.get, words))
        if None in found:
            for i, bucket in enumerate(found):
                if bucket is None:
                    found[i] = bucket = zlib.crc32(words[i]) % self.buckets
                    if len(words[i]) <= KEPT_BYTES:
                        self.kept[words[i]] = bucket
        return np.array(found, np.int64)

    def of(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """For each window of ``text``: its words, and the buckets of the features that end in it."""
        at, before = 0, []
        while at < len(text):
            end = at + WINDOW
            if end < len(text):  # up to the last word that ends here, or else to the end of the word
                part = text[at:end].translate(self.table)
                cut = part.rfind(b" ")
                while cut < 0 and end < len(text):
                    more = text[end : end + WINDOW].translate(self.table)
                    cut = more.find(b" ")
                    cut = cut + len(part) if cut >= 0 else cut
                    part, end = part + more, end + WINDOW
                part = part[:cut] if cut >= 0 else part
            else:
                part = text[at:].translate(self.table)
            at += max(1, len(part))
            words = part.split()
            if words:
                cells = [self._single(words)]
                for n in range(2, self.longest + 1):
                    chain = (before + words)[-(len(words) + n - 1) :]
                    runs = [b" ".join(chain[i : i + n]) for i in range(len(chain) - n + 1)]
                    cells.append(np.array([zlib.crc32(r) % self.buckets for r in runs], np.int64))
                before = (before + words)[-(self.longest - 1) :] if self.longest > 1 else []
                yield len(words), np.concatenate(cells)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> dict[int, int]:
    """Features per bucket over all rows of ``texts`` (text); at most ``buckets`` numbers reach the driver."""

    def count(batches):
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in utf8(column(batch, "text")):
                for _, cells in features.of(text):
                    total += np.bincount(cells, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(own: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket the whole thousandths of the log ratio of its smoothed shares in target and documents."""
    all_own, all_target = float(sum(own.values())), float(sum(target.values()))
    ratio = lambda b: (target.get(b, 0) + 1.0) * (all_own + buckets) / ((own.get(b, 0) + 1.0) * (all_target + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Whole thousandths of a Gumbel number made from the id's SHA-256; a null id is an empty string."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for each row of ``docs``."""

    def weigh(batches):
        features = Features(len(gain), longest)
        for batch in slices(batches):
            figures = []
            for text in utf8(column(batch, "text")):
                words = n = total = 0
                for w, cells in features.of(text):
                    words, n, total = words + w, n + len(cells), total + int(gain[cells].sum())
                figures.append((words, n, total // n if n else 0))
            arrays = [pa.array([f[i] for f in figures], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def bisected(low: int, high: int, wanted: int, counts: Callable[[list[int]], list[int]], levels: int = LEVELS) -> int:
    """The least whole number x in low..high with at least ``wanted`` rows at or below it.

    ``counts`` gives the rows at or below each of some numbers; ``high`` has enough.  Each call settles
    ``levels`` halvings: it counts at all middles that they could ask for.
    """
    while low < high:
        width, parts = high - low, 1 << levels
        middles = sorted({low + width * i // parts for i in range(parts)} - {high})
        for x, n in zip(middles, counts(middles), strict=True):
            if n >= wanted:
                high = min(high, x)
            else:
                low = max(low, x + 1)
    return low


def cutoff(scores: DataFrame, wanted: int) -> tuple[int, int | None, int]:
    """(score, doc_id, rows at that score and id that are drawn) of the last of ``wanted`` drawn rows.

    Rows are drawn by descending score, then ascending doc_id, null ids last; 1 <= wanted <= rows.
    """

    def least(rows: DataFrame, value: Column, wanted: int) -> int:
        low, high = rows.agg(F.min(value), F.max(value)).first()
        at_most = lambda xs: list(rows.agg(*[F.count(F.when(value <= x, 1)) for x in xs]).first())
        return bisected(low, high, wanted, at_most)

    score = -least(scores, -F.col("score"), wanted)
    wanted -= scores.where(F.col("score") > score).count()
    tied = scores.where(F.col("score") == score)
    known = tied.where(F.col("doc_id").isNotNull())
    n = known.count()
    if n < wanted:
        return score, None, wanted - n
    doc_id = least(known, F.col("doc_id"), wanted)
    return score, doc_id, wanted - known.where(F.col("doc_id") < doc_id).count()


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in ``order``, from ranges that are sorted each on its own."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_place", F.monotonically_increasing_id()), "ranges")  # partition, then row in it
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    ahead = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # one row for each shuffle partition, a number that is set by the session and not by the data
    ahead = ahead.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    joined = placed.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return joined.withColumn(name, F.col("_ahead") + place + 1).drop("_part", "_place", "_ahead")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of ``docs`` (doc_id, text).

    Drawn are ``percent`` of the documents with at least ``least_words`` words, rounded down, in the order
    of score; the others' rank is null.  A null text has no words, weight 0 and its id's Gumbel number as
    score; ties go to the smaller doc_id, null ids last; repeated rows are documents of their own, and
    equal ids with equal scores go by their number of features; an empty table gives an empty result and
    an empty ``target`` one where rare words win; columns other than doc_id and text are ignored.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest), buckets)
    scores = stage(scored(docs, gain, longest, seed).withColumn("_row", F.monotonically_increasing_id()), "scores")
    out = ["doc_id", "n_features", "weight", "score"]
    rank = F.lit(None).cast("long").alias("rank")
    enough = F.col("n_words") >= least_words
    able = scores.where(enough)
    wanted = able.count() * percent // 100
    if not wanted:
        return scores.select(*out, rank)
    score, doc_id, _ = cutoff(able, wanted)
    tie = F.lit(True) if doc_id is None else F.coalesce(F.col("doc_id") <= doc_id, F.lit(False))
    inside = enough & ((F.col("score") > score) | ((F.col("score") == score) & tie))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("_row").asc()]
    drawn = ranked(scores.where(inside).select(*out, "_row"), order)
    # rows with the score and the id of the last one can be more than are drawn
    drawn = drawn.select(*out, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.union(scores.where(~inside).select(*out, rank))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn ids, best first: doc_id and rank, for a join with the documents."""
    found = resample(docs, target, **options)
    return found.where("rank is not null").select("doc_id", "rank")
