"""Near-duplicate vectors by cosine: tiles in the order of principal components, cut short by bounds.

Vectors are scaled to length 1 and turned so that the leading coordinates hold most of the variance.
Only vectors with equal labels are compared.  Vectors of a label are cut by their first coordinate into
slots so wide that linked vectors lie in the same or in neighbouring slots, and slots into tiles of
bounded size; each pair of tiles is a unit of work.  Within it products are accumulated over leading
coordinates first; what the rest can add is at most the product of the suffixes' lengths, and pairs that
cannot reach the threshold stop there.  The pairs left are decided by the cosine of the vectors as given.

A unit returns counts and a spanning forest of its links, never all links, so dense groups stay small.
Equal vectors are one node with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.batches import column, slices
from quillpanel.llm.components import components
from quillpanel.session import stage

THRESHOLD = 0.93
TILE = 1024
ROWS = 256
STEPS = (8, 16, 32)
#: Room for rounding in the bounds; the decision itself is taken in double precision on the given vectors.
ROOM = 1e-6


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of unit vectors' coordinates, one table per task and dimension."""
    sums: dict[int, np.ndarray] = {}
    for batch in slices(batches):
        by_size: dict[int, list] = {}
        for v in column(batch, "vector"):
            by_size.setdefault(len(v), []).append(v)
        for d, rows in by_size.items():
            x = unit(np.array(rows, np.float64))
            sums[d] = sums.get(d, 0) + x.T @ x
    dims = sorted(sums)
    i = [np.repeat(np.arange(d), d) for d in dims]
    j = [np.tile(np.arange(d), d) for d in dims]
    put = lambda parts, kind: pa.array(np.concatenate([np.asarray(p, kind) for p in parts]) if parts else np.zeros(0, kind))
    yield pa.RecordBatch.from_arrays(
        [put([np.full(d * d, d) for d in dims], np.int32), put(i, np.int32), put(j, np.int32), put([sums[d].ravel() for d in dims], np.float64)],
        ["d", "i", "j", "s"],
    )


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very large and very small ones keep their direction."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the principal axes of all unit vectors, largest variance first."""
    sums = vectors.select("vector").mapInArrow(_moments, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    rows = sums.toPandas()  # the square of the dimension
    for d, part in rows.groupby("d"):
        m = np.zeros((d, d))
        m[part.i, part.j] = part.s
        values, axes = np.linalg.eigh((m + m.T) / 2)
        out[int(d)] = axes[:, np.argsort(-values)]
    return out


def _turned(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value
        for batch in slices(batches):
            rows = column(batch, "vector")
            turned = [None] * len(rows)
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(rows):
                by_size.setdefault(len(v), []).append(k)
            for d, ks in by_size.items():
                y = unit(np.array([rows[k] for k in ks], np.float64)) @ axes[d]
                for k, v in zip(ks, y, strict=True):
                    turned[k] = v
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(n)) for n in ("node", "label", "times")),
                    pa.array([len(v) for v in rows], pa.int32()),
                    pa.array([float(t[0]) for t in turned], pa.float64()),
                    pa.array([np.asarray(v, np.float64).tobytes() for v in rows], pa.binary()),
                    pa.array([t.astype(np.float32).tobytes() for t in turned], pa.binary()),
                ],
                ["node", "label", "times", "d", "lead", "vector", "turned"],
            )

    return run


def close_pairs(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs of rows of ``x`` and ``y`` (turned: ``a`` and ``b``) with a cosine of at least ``threshold``."""
    d = a.shape[1]
    ends = [e for e in STEPS if e < d]
    rest = lambda m, k: np.sqrt((m[:, k:].astype(np.float64) ** 2).sum(axis=1))
    first = ends[0] if ends else d
    tail_a, tail_b = rest(a, first), rest(b, first)
    found_i, found_j = [], []
    for at in range(0, len(a), ROWS):
        part = a[at : at + ROWS, :first].astype(np.float64) @ b[:, :first].T.astype(np.float64)
        i, j = np.nonzero(part + tail_a[at : at + ROWS, None] * tail_b[None] >= threshold - ROOM)
        so_far = part[i, j]
        i += at
        for begin, end in zip(ends, [*ends[1:], d], strict=False):  # none where the first step took all
            so_far = so_far + np.einsum("ij,ij->i", a[i, begin:end], b[j, begin:end], dtype=np.float64)
            keep = so_far + rest(a, end)[i] * rest(b, end)[j] >= threshold - ROOM
            i, j, so_far = i[keep], j[keep], so_far[keep]
        u, v = x[i], y[j]
        dot = np.einsum("ij,ij->i", u, v)
        cosine = dot / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
        found_i.append(i[cosine >= threshold])
        found_j.append(j[cosine >= threshold])
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that keep ``n`` nodes connected as all the links do."""
    root = np.arange(n)

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return int(k)

    kept = []
    for u, v in zip(i.tolist(), j.tolist(), strict=True):
        p, q = top(u), top(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((u, v))
    return kept


def _units(threshold: float):
    """Links of each tile pair; rows come sorted by (label, d, i, j)."""

    def links(group: list[tuple]) -> tuple[list, list]:
        _, _, i, j, *_ = group[0]
        first = [g for g in group if g[4] == i]
        second = first if i == j else [g for g in group if g[4] == j]
        if not first or not second:
            return [], []
        read = lambda rows, k, kind: np.frombuffer(b"".join(g[k] for g in rows), kind).reshape(len(rows), -1)
        p, q = close_pairs(read(first, 8, np.float32), read(second, 8, np.float32), scaled(read(first, 7, np.float64)), scaled(read(second, 7, np.float64)), threshold)
        if i == j:
            p, q = p[p < q], q[p < q]
        nodes = [g[5] for g in first] + ([] if i == j else [g[5] for g in second])
        times = np.array([g[6] for g in first] + ([] if i == j else [g[6] for g in second]), np.int64)
        shift = 0 if i == j else len(first)
        q = q + shift
        count = np.bincount(p, times[q], len(nodes)) + np.bincount(q, times[p], len(nodes))
        return [(nodes[u], nodes[v]) for u, v in forest(p, q, len(nodes))], [(nodes[k], int(count[k])) for k in np.flatnonzero(count)]

    def rows_of(edges: list, counts: list) -> pa.RecordBatch:
        a = [e[0] for e in edges] + [c[0] for c in counts]
        b = [e[1] for e in edges] + [None] * len(counts)
        n = [0] * len(edges) + [c[1] for c in counts]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "d", "i", "j", "tile", "node", "times", "vector", "turned"]
        group: list[tuple] = []
        for batch in slices(batches):
            for row in zip(*[column(batch, n) for n in names], strict=True):
                if group and row[:4] != group[0][:4]:
                    yield rows_of(*links(group))
                    group = []
                group.append(row)
        if group:
            yield rows_of(*links(group))

    return run


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, which changes no digit of a cosine."""
    return x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))))


def tile_pairs(nodes: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """A row of ``nodes`` for each pair of tiles that it belongs to: label, d, i, j, tile and the node's columns."""
    # Unit vectors with a cosine of c or more differ by at most the root of 2 - 2c in any coordinate.
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-5
    group = ["label", "d"]
    slotted = nodes.withColumn("slot", F.floor((F.col("lead") + 1) / width).cast("int"))
    sizes = slotted.groupBy(*group, "slot").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    by = lambda k: sizes.select(*group, (F.col("slot") - k).alias("slot"), F.col("tiles").alias(f"tiles{'_up' if k > 0 else '_down'}"))
    around = sizes.join(by(1), [*group, "slot"], "left").join(by(-1), [*group, "slot"], "left").na.fill(0, ["tiles_up", "tiles_down"])
    rows = slotted.join(around, [*group, "slot"])
    # A tile's number: slot, then place in it; a pair is named by its smaller and its larger number.
    number = lambda slot, place: slot.cast("long") * (1 << 32) + place
    rows = rows.withColumn("place", F.pmod(F.xxhash64("node"), F.col("tiles")))

    def numbers(step: int, n: str) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.col(n)), lambda k: k < F.col(n))
        return F.transform(places, lambda k: number(F.col("slot") + step, k))

    others = F.concat(numbers(0, "tiles"), numbers(1, "tiles_up"), numbers(-1, "tiles_down"))
    rows = rows.withColumn("tile", number(F.col("slot"), F.col("place"))).withColumn("other", F.explode(others))
    return rows.select(*group, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "times", "vector", "turned")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``rows`` (vec_id, label, embedding).

    Rows link with rows of the same label and number of components.  A row with a null label, or whose
    vector is null, empty, zero or holds a null or non-finite component, links with nothing.  Repeated
    rows are vectors of their own; equal vectors of a label link with one another; where vec_ids repeat
    they name one component.  An empty table gives an empty result; other columns are ignored.
    """
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("label").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # Equal vectors are one node, named by the smallest vec_id; the copies come in one group, summed where they lie.
    grouped = rows.where("good").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("times"))
    nodes = stage(grouped, "vectors")
    axes = rotations(nodes)
    shared = rows.sparkSession.sparkContext.broadcast(axes)  # the square of the dimension
    turned = nodes.select("node", "label", "times", "vector").mapInArrow(
        _turned(shared), "node long, label long, times long, d int, lead double, vector binary, turned binary"
    )
    pairs = tile_pairs(stage(turned, "turned"), threshold)
    keys = ["label", "d", "i", "j"]
    found = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_units(threshold), "a long, b long, n long")
    found = stage(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    whole = components(found.where("b is not null").select("a", "b"))
    known = nodes.join(counts, "node", "left").join(whole, "node", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    out = rows.join(known, F.col("good") & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
