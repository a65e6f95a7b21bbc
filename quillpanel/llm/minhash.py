"""Near copies by one-permutation MinHash, banded buckets and star-shaped candidates.

A document's distinct 5-word shingles are hashed once; the hash range is cut into bins and the least
hash of each bin is the signature.  An empty bin takes the value of a bin found by a fixed hash sequence
(optimal densification).  Rows of the signature form bands; documents that agree in a band meet in a
bucket.  Exact copies of a set meet before as one node.

In a bucket only the pairs with its centre, the smallest document, are candidates, so candidates grow
with the bucket, not with its square.  All candidates are confirmed on the full shingle sets.  What the
star leaves open is handled exactly: in a bucket whose documents are not yet of one component, every
document outside the largest component is compared with all others, in tiles of bounded size, by figures
that can only overstate a similarity: two sets of up to SKETCH shingles by the low 16 bits of all their
hashes, other pairs by how many shingles fall into each of CELLS cells.  Pairs that this allows to link
are confirmed on the full sets as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.llm.batches import column, in_batches, slices, unused, utf8
from quillpanel.llm.components import components
from quillpanel.llm.words import mixed, shingle_sets, space_table
from quillpanel.session import stage

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
PROBES = 64
TILE = 512
#: Sets of at most so many shingles carry the low 16 bits of their hashes, longer ones counts by cell.
SKETCH = 400
CELLS = 1024
#: A count that stands for any larger one too.
FULL = 65535

#: Lists of ids up to this length are sent to every task (16 MB); with longer ones the texts move to meet them.
MOST_IDS = 1_000_000

SETS = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"


def probe_table() -> np.ndarray:
    """For each bin the bins that lend it a value, in order of trial."""
    bins, trial = np.arange(BINS, dtype=np.uint64)[:, None], np.arange(PROBES, dtype=np.uint64)[None]
    return (mixed(bins * np.uint64(PROBES) + trial, 77) % np.uint64(BINS)).astype(np.int64)


def signature(hashes: np.ndarray, edges: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Least hash of each bin of a non-empty sorted set, empty bins densified; ``edges`` are the bins' lower ends."""
    at = np.append(np.searchsorted(hashes, edges), len(hashes))
    full = at[1:] > at[:-1]
    values = hashes[np.minimum(at[:-1], len(hashes) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        lends = full[probes[empty]]
        lender = probes[empty, lends.argmax(axis=1)]
        lost = ~lends.any(axis=1)  # no trial hit a full bin: the next full one lends
        if lost.any():
            filled = np.flatnonzero(full)
            lender[lost] = filled[np.searchsorted(filled, empty[lost]) % len(filled)]
        values[empty] = values[lender]
    return values


def sketch(hashes: np.ndarray) -> bytes:
    """Low 16 bits of all hashes of a short set; of a long one its size and its counts by the low bits of the hashes."""
    if len(hashes) <= SKETCH:
        return hashes.astype(np.uint16).tobytes()
    cells = np.bincount((hashes & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return len(hashes).to_bytes(8, "little") + np.minimum(cells, FULL).astype(np.uint16).tobytes()


def opened(sketch: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Size, low 16 bits of the hashes (none of a long set) and counts by cell."""
    if len(sketch) <= 2 * SKETCH:
        low = np.frombuffer(sketch, np.uint16)
        return len(low), low, np.bincount(low & (CELLS - 1), minlength=CELLS).astype(np.int32)
    cells = np.frombuffer(sketch, np.uint16, offset=8).astype(np.int32)
    return int.from_bytes(sketch[:8], "little"), np.zeros(0, np.uint16), np.where(cells == FULL, 1 << 30, cells).astype(np.int32)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spaces, probes = space_table(), probe_table()
    edges = np.array([(b << 64) // BINS for b in range(BINS)], np.uint64)
    salts = mixed(np.arange(1, ROWS + 1, dtype=np.uint64), 5) | np.uint64(1)
    signed = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
    for batch in slices(batches):
        sets = shingle_sets([t.lower() for t in utf8(column(batch, "text"))], spaces, SHINGLE)
        keys = np.zeros((len(sets), BANDS), np.uint64)
        for i, s in enumerate(sets):
            if len(s):
                values = signature(s, edges, probes)
                rows = values.reshape(BANDS, ROWS)
                keys[i] = mixed((rows * salts).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.array([len(s) for s in sets], pa.int64()),
                signed([mixed(s, 1).sum(dtype=np.uint64) for s in sets]),
                signed([mixed(s, 2).sum(dtype=np.uint64) for s in sets]),
                pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), signed(keys.ravel())),
                pa.array([sketch(s) for s in sets], pa.binary()),
            ],
            [c.split()[0] for c in SETS.split(", ")],
        )


def _full_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spaces = space_table()
    for batch in slices(batches):
        sets = shingle_sets([t.lower() for t in utf8(column(batch, "text"))], spaces, SHINGLE)
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["doc_id", "set"],
        )


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Similarity of two distinct arrays is at least ``percent`` hundredths; repeats within one can only overstate it."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large or not small:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [[np.frombuffer(x, np.uint64) for x in column(batch, c)] for c in ("set_a", "set_b")]
            keep = [linked(a, b, percent) for a, b in zip(*sets, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def listed(ids: DataFrame) -> DataFrame:
    """``ids`` stored; marked for every task if their number, which is counted, allows it."""
    ids = stage(ids, "ids")
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, b) of doc_ids whose full shingle sets are similar; stored."""
    pairs = stage(pairs, "pairs")
    needed = listed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = docs.join(needed, "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, set binary")
    sets = sets.distinct()  # of repeated rows; a doc_id with several texts has several sets
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"set_{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")
    return stage(joined.mapInArrow(_confirm(percent), "a long, b long").distinct(), "confirmed")


def _candidates(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each tile pair; rows come sorted by (key, i, j)."""

    def pairs(group: list[tuple]) -> list[tuple[int, int]]:
        _, i, j, _, _, _, band, centre, *_ = group[0]
        first = [g for g in group if g[3] == i]
        second = first if i == j else [g for g in group if g[3] == j]
        if not first or not second:
            return []
        arrays = []
        for rows in (first, second):
            sizes, low, cells = zip(*[opened(g[9]) for g in rows], strict=True)
            arrays.append((
                np.array([g[4] for g in rows]),
                np.array([g[5] for g in rows]),
                np.array([g[8] for g in rows], np.int64),
                np.array(sizes, np.int64),
                low,
                np.stack(cells),
            ))
        (n1, c1, b1, l1, k1, h1), (n2, c2, b2, l2, k2, h2) = arrays
        brief1, brief2 = l1 <= SKETCH, l2 <= SKETCH
        short = np.flatnonzero(brief2)
        joined, starts = np.concatenate(k2), np.cumsum(l2[short]) - l2[short]
        there, found = np.zeros(1 << 16, bool), []
        for at in range(0, len(n1), 64):
            own_l = l1[at : at + 64, None]
            open_ = 100 * np.minimum(own_l, l2) >= percent * np.maximum(own_l, l2)
            open_ &= c1[at : at + 64, None] != c2[None]
            open_ &= (n1[at : at + 64, None] != centre) & (n2[None] != centre)
            if i == j:
                open_ &= n1[at : at + 64, None] < n2[None]
            for x in np.flatnonzero(open_.any(axis=1)):
                # Equal hashes have equal low bits, so that both ways can only overstate what is common.
                own = l1[at + x]
                if brief1[at + x] and open_[x, short].any():
                    there[k1[at + x]] = True
                    common = np.minimum(np.add.reduceat(there[joined], starts, dtype=np.int64), own)
                    open_[x, short] &= 100 * common >= percent * (own + l2[short] - common)
                    there[k1[at + x]] = False
                rest = np.flatnonzero(open_[x] & ~(brief1[at + x] & brief2))
                if len(rest):
                    common = np.minimum(h1[at + x], h2[rest]).sum(axis=1, dtype=np.int64)
                    common = np.minimum(common, np.minimum(own, l2[rest]))
                    open_[x, rest] = 100 * common >= percent * (own + l2[rest] - common)
            x, y = np.nonzero(open_)
            x += at
            own = (b1[x] == b2[y]).argmax(axis=1) == band  # each pair in the first band that it shares
            for p, q in zip(x[own].tolist(), y[own].tolist(), strict=True):
                found.append((min(first[p][4], second[q][4]), max(first[p][4], second[q][4])))
        return found

    names = ["key", "i", "j", "tile", "node", "comp", "band", "centre", "bands", "sketch"]
    group, out = [], []

    def batch_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in slices(batches):
        for row in zip(*[column(batch, n) for n in names], strict=True):
            if group and row[:3] != group[0][:3]:
                out += pairs(group)
                group = []
            group.append(row)
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    if group:
        out += pairs(group)
    yield batch_of(out)


def _compare(percent: int):
    return lambda batches: _candidates(batches, percent)


def open_pairs(buckets: DataFrame, nodes: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs that the stars left open: in one bucket, of different components, alike by sketch.

    ``buckets``: key, band, node, centre, size of every bucket of two or more.  Only buckets of three or
    more with several components have such pairs.  Documents outside a bucket's largest component are
    cut into tiles, those inside into others, and each tile of the former meets every tile.
    """
    comp = F.coalesce("component", "node").alias("comp")
    placed = buckets.where("size > 2").join(found, "node", "left").select("key", "band", "node", "centre", comp)
    by_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed_ = by_comp.groupBy("key").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("big"), F.max("n").alias("n_big"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("comps")
    )
    mixed_ = mixed_.where("comps > 1").select(
        "key", "big", F.ceil((F.col("n_all") - F.col("n_big")) / TILE).cast("int").alias("rest_tiles"), F.ceil(F.col("n_big") / TILE).cast("int").alias("big_tiles")
    )
    rows = placed.join(mixed_, "key")
    inside = F.col("comp") == F.col("big")
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    tile = F.when(inside, F.col("rest_tiles") + spread(F.col("big_tiles"))).otherwise(spread(F.col("rest_tiles")))
    last = F.when(inside, F.col("rest_tiles")).otherwise(F.col("rest_tiles") + F.col("big_tiles")) - 1
    rows = rows.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "comp", "band", "centre")
    rows = rows.join(nodes.select("node", "bands", "sketch"), "node")
    rows = rows.select("key", "i", "j", "tile", "node", "comp", F.col("band").cast("int"), "centre", "bands", "sketch")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(percent), "a long, b long")


def near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and link with nothing.  Rows that repeat a doc_id count as
    documents of their own by their texts; rows with a null doc_id get no component and are kept.  Ties
    don't matter: a component is named by its smallest doc_id.  An empty table gives an empty result;
    other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = stage(in_batches(docs).mapInArrow(_signatures, SETS), "sets")
    digest = ["d1", "d2", "n_shingles"]
    groups = sets.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("node"))
    groups = stage(groups, "groups")
    # A node has one row, or several where its doc_id has several texts.
    nodes = sets.join(groups, digest).where("doc_id = node").select("node", "bands", "sketch").distinct()
    nodes = stage(nodes, "nodes")
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    stars = rows.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stage(rows.join(stars, "key"), "buckets")
    pairs = buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    first = confirmed(pairs, docs, percent)
    found = components(first)
    second = confirmed(open_pairs(buckets, nodes, found, percent).distinct(), docs, percent)
    found = components(first.union(second))
    out = sets.join(groups, digest, "left").join(found, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they are, whatever their names.

    Of rows that repeat the kept doc_id the one with the smallest text stays; rows without shingles stay, and
    so do rows with a null doc_id.  An empty table gives an empty result.
    """
    kept_id, n_rows, place = (unused(n, *docs.columns) for n in ("_kept_id", "_rows", "_place"))
    found = near_copies(docs, percent).where("doc_id is not null").groupBy("doc_id")
    kept = found.agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_kept")
    kept = listed(kept.select(F.col("doc_id").alias(kept_id), F.col("_n").alias(n_rows)))
    rows = docs.join(kept, F.col("doc_id") == F.col(kept_id), "left")
    once = rows.where(F.col("doc_id").isNull() | (F.col(n_rows) == 1))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))
    again = rows.where(F.col(n_rows) > 1).withColumn(place, number).where(F.col(place) == 1).drop(place)
    return once.union(again).drop(kept_id, n_rows)
