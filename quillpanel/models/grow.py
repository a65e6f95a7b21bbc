"""Forests and boosted trees, grown level by level over blocks of rows.

Rows are packed once into blocks of at most BLOCK_ROWS, feature after feature, with a byte for each value:
its bin between cuts that are exact quantiles of all training rows.  A level of all trees is one pass: each
task adds up the targets by (node, feature, bin) over its blocks, tree after tree, and the sums of a tree
meet in one group that finds the best cuts, so what moves doesn't grow with the rows of a block.  Once a
deep tree's nodes are small, the rows of each node meet in a group of at most LOCAL_ROWS that grows the rest.
The driver holds the trees, whose size is bounded by their number and depth.

Folds are grown side by side: a tree belongs to a group, and group g learns from the rows outside fold g,
with cuts from these rows alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel.session import stage

BLOCK_ROWS = 1 << 16
BINS = 32
#: Most drawn rows of a node that one group grows to the end.
LOCAL_ROWS = 200_000
#: Sums of one tree's level below which a tree is grown by passes to its depth.
LEVEL_BYTES = 1 << 20
#: Rounds of boosting whose trees tasks apply to the stored margins.
KEPT_ROUNDS = 10
#: Levels of a tree that rows go through by the masks of all their nodes.
MASK_DEPTH = 5

BLOCK = "block long, n int, x binary, y binary, w binary, fold binary, margin binary"
#: Poisson counts of mean 1, by a 16-bit number.
_SHARES = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(9)])
DRAWS = np.searchsorted(_SHARES, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _packer(n_features: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block(rows: np.ndarray) -> pa.RecordBatch:
            x, y, w, fold = rows[:n_features], rows[n_features], rows[n_features + 1], rows[n_features + 2]
            if np.isnan(rows).any():
                raise ValueError("a feature, label or weight is missing")
            values = [number, rows.shape[1], x.tobytes(), y.tobytes(), w.tobytes(), fold.astype(np.int32).tobytes(), b""]
            return pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in BLOCK.split(", ")], values, strict=True))], _arrow(BLOCK))

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
            size += batch.num_rows
            while size >= BLOCK_ROWS:
                rows = np.concatenate(held, axis=1)
                yield block(rows[:, :BLOCK_ROWS])
                held, size, number = [rows[:, BLOCK_ROWS:]], size - BLOCK_ROWS, number + 1
        if size:
            yield block(np.concatenate(held, axis=1))

    return run


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))])


def packed(df: DataFrame, features: list[str], label: str, weight: str | None, fold: str | None) -> DataFrame:
    """Blocks of the rows' values, stored; x holds doubles, feature after feature."""
    as_double = lambda c: F.col(c).cast("double")
    columns = [as_double(f).alias(f"f{i}") for i, f in enumerate(features)]
    columns += [as_double(label).alias("y"), (as_double(weight) if weight else F.lit(1.0)).alias("w")]
    columns.append((as_double(fold) if fold else F.lit(-1.0)).alias("fold"))
    return stage(df.select(*columns).mapInArrow(_packer(len(features)), BLOCK), "blocks")


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _unordered(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _each_feature(row: dict, groups: int, n_features: int) -> Iterator[tuple[int, int, np.ndarray]]:
    x = np.frombuffer(row["x"]).reshape(n_features, row["n"])
    fold = np.frombuffer(row["fold"], np.int32)
    for g in range(groups):
        rows = fold != g
        if rows.any():
            for f in range(n_features):
                yield g, f, x[f, rows]


def cuts(raw: DataFrame, groups: int, n_features: int, bins: int = BINS) -> list[list[np.ndarray]]:
    """By group and feature: midpoints above each value of a feature with at most ``bins`` values, else above
    the exact quantiles of its rows.

    Quantiles are found 16 bits at a time, so no feature's values are sorted in one place.
    """

    def few(batches):
        for row in _rows(batches):
            for g, f, x in _each_feature(row, groups, n_features):
                values = np.unique(x + 0.0)
                many = len(values) > bins
                values = values[:1] if many else values
                yield _batch("g int, f int, n long, many int, v double", [g] * len(values), [f] * len(values), [len(x)] + [0] * (len(values) - 1), [int(many)] * len(values), values)

    found = raw.mapInArrow(few, "g int, f int, n long, many int, v double").groupBy("g", "f", "v").agg(F.sum("n").alias("n"), F.max("many").alias("many"))
    found = found.groupBy("g", "f").agg(F.sum("n").alias("n"), F.max("many").alias("many"), F.array_sort(F.collect_set("v")).alias("v")).collect()
    out = [[np.array([]) for _ in range(n_features)] for _ in range(groups)]
    places = {}  # (g, f) -> per quantile: the bits known of it and its place among the rows that share them
    for r in found:
        if not r.many and len(r.v) <= bins:
            out[r.g][r.f] = _between(np.array(r.v[:-1]), np.array(r.v[1:]))
        else:
            places[r.g, r.f] = [(0, -(-j * r.n // bins)) for j in range(1, bins)]
    if not places:
        return out
    for shift in (48, 32, 16, 0):
        known = {k: np.array(sorted({p for p, _ in v}), np.uint64) for k, v in places.items()}

        def digits(batches, known=known, shift=shift):
            for row in _rows(batches):
                for g, f, x in _each_feature(row, groups, n_features):
                    if (g, f) in known:
                        mine, key = known[g, f], _ordered(x)
                        above = key >> np.uint64(shift + 16) if shift < 48 else np.zeros(len(key), np.uint64)
                        at = np.minimum(np.searchsorted(mine, above), len(mine) - 1)
                        hit = mine[at] == above
                        code = (at[hit] << 16) + ((key[hit] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
                        code, n = np.unique(code, return_counts=True)
                        yield _batch("g int, f int, at long, digit long, n long", [g] * len(code), [f] * len(code), code >> 16, code & 0xFFFF, n)

        counted = raw.mapInArrow(digits, "g int, f int, at long, digit long, n long").groupBy("g", "f", "at", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("g", "f", "at").orderBy("digit").rowsBetween(W.unboundedPreceding, 0))  # at most 65536 rows
        asked = [(g, f, int(np.searchsorted(known[g, f], np.uint64(p))), j, int(rank)) for (g, f), v in places.items() for j, (p, rank) in enumerate(v)]
        asked = raw.sparkSession.createDataFrame(asked, "g int, f int, at long, j int, rank long")
        reached = counted.withColumn("upto", upto).join(F.broadcast(asked), ["g", "f", "at"]).where("upto >= rank and upto - n < rank")
        for r in reached.select("g", "f", "j", "digit", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).collect():
            places[r.g, r.f][r.j] = ((places[r.g, r.f][r.j][0] << 16) + r.digit, r["rank"])
    value = {k: np.array(sorted({_unordered(p) for p, _ in v})) for k, v in places.items()}

    def following(batches):
        for row in _rows(batches):
            for g, f, x in _each_feature(row, groups, n_features):
                if (g, f) in value:
                    x = np.append(np.sort(x), np.inf)
                    above = x[np.searchsorted(x[:-1], value[g, f], "right")]
                    yield _batch("g int, f int, j int, v double", [g] * len(above), [f] * len(above), range(len(above)), above)

    least = raw.mapInArrow(following, "g int, f int, j int, v double").groupBy("g", "f", "j").agg(F.min("v").alias("v"))
    for r in least.groupBy("g", "f").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("p")).collect():
        above = np.array([p.v for p in r.p])
        there = np.isfinite(above)  # above the largest value there is nothing to cut off
        out[r.g][r.f] = _between(value[r.g, r.f][there], above[there])
    return out


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = low + (high - low) / 2
    return np.where(middle < high, middle, low)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    fields = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.types, strict=True)], schema=fields)


def binned(raw: DataFrame, at: list[list[np.ndarray]], margins: bool) -> DataFrame:
    """The blocks with x in bins: for each group, feature after feature; stored.  Margins start at 0."""
    groups, n_features = len(at), len(at[0])

    def run(batches):
        for row in _rows(batches):
            x = np.frombuffer(row["x"]).reshape(n_features, row["n"])
            bins = b"".join(_bins(x, at[g]).tobytes() for g in range(groups))
            yield pa.RecordBatch.from_pylist([{**row, "x": bins, "margin": bytes(8 * groups * row["n"]) if margins else b""}], _arrow(BLOCK))

    return stage(raw.mapInArrow(run, BLOCK), "bins")


def _bins(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(at[f], x[f], "left").astype(np.uint8) for f in range(len(at))])


@dataclass
class Trees:
    """Complete binary trees of ``depth``: node i has the children 2i + 1 (bin <= cut) and 2i + 2; a leaf's feature is -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, n: int, depth: int) -> Trees:
        size = (1 << depth + 1) - 1
        return cls(np.full((n, size), -1, np.int8), np.zeros((n, size), np.uint8), np.zeros((n, size)))

    @property
    def depth(self) -> int:
        return self.feature.shape[1].bit_length() - 1

    def places(self, t: int, x: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row of ``x`` (features, rows) has come to after ``levels``.

        Masks take rows through the first levels, which have few nodes, and a gather a level through the rest.
        """
        n, top = x.shape[1], min(levels, self.depth, MASK_DEPTH)
        feature, cut = self.feature[t], self.cut[t]
        inner = feature >= 0
        at = self._ends(t, top, np.arange(len(feature)))[self.reached(t, x, top)]
        row, flat, begin = np.arange(n), x.reshape(-1), np.maximum(feature, 0).astype(np.int64) * n
        for _ in range(top, levels):
            go = inner[at]
            if not go.any():
                break
            at = np.where(go, 2 * at + 1 + (flat[begin[at] + row] > cut[at]), at)
        return at.astype(np.int32)

    def _ends(self, t: int, levels: int, of_node: np.ndarray) -> np.ndarray:
        """``of_node`` by place in a level of :meth:`reached`: the node's there, or its last ancestor's."""
        ends = of_node[:1]
        for level in range(levels):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            children = of_node[nodes.stop : 2 * nodes.stop + 1].reshape(-1, 2)
            ends = np.where(self.feature[t, nodes, None] >= 0, children, ends[:, None]).reshape(-1)
        return ends

    def reached(self, t: int, x: np.ndarray, levels: int) -> np.ndarray:
        """As :meth:`places`, but counted from the level's first node, and below a leaf rows go on to the left.

        A comparison of all rows for each node and bitwise choices between them: a few passes over bytes.
        """
        feature, cut = self.feature[t], self.cut[t]
        at, gone = np.zeros(x.shape[1], np.uint8), []
        for level in range(levels):
            layer = [x[feature[i]] > cut[i] if feature[i] >= 0 else None for i in range((1 << level) - 1, (2 << level) - 1)]
            for right in reversed(gone):
                layer = [_chosen(right, *pair) for pair in zip(layer[::2], layer[1::2], strict=True)]
            at <<= 1
            if layer[0] is not None:
                at |= layer[0]
            gone.append(layer[0])
        return at

    def values(self, t: int, x: np.ndarray) -> np.ndarray:
        if self.depth > MASK_DEPTH:
            return self.value[t][self.places(t, x, self.depth)]
        return self._ends(t, self.depth, self.value[t])[self.reached(t, x, self.depth)]


def _chosen(right: np.ndarray | None, low: np.ndarray | None, high: np.ndarray | None) -> np.ndarray | None:
    """``high`` where ``right``, else ``low``; None is False everywhere."""
    if right is None:
        return low
    if high is None:
        return low if low is None else low & ~right
    return right & high if low is None else low ^ (right & (low ^ high))


def level_sums(x: np.ndarray, slot: np.ndarray, slots: int, count: np.ndarray | None, w: np.ndarray | None, wy: np.ndarray, bins: int) -> np.ndarray:
    """(statistic, slot, feature, bin): numbers of rows, weights and weighted targets; None is one a row."""
    out = np.zeros((3, slots, len(x), bins))
    base = slot.astype(np.int64) * bins
    for f in range(len(x)):
        code = base + x[f]
        for s, values in enumerate((count, w, wy)):
            out[s, :, f] = out[0, :, f] if s == 1 and w is count else np.bincount(code, values, slots * bins).reshape(slots, bins)
    return out


def _allowed(seed: int, tree: int, node: np.ndarray, n_features: int, most: int) -> np.ndarray:
    """(node, feature): whether the feature is among the ``most`` that the node may look at."""
    if most >= n_features:
        return np.ones((len(node), n_features), bool)
    u = np.uint64
    h = node.astype(u)[:, None] * u(0x9E3779B97F4A7C15) + np.arange(1, n_features + 1, dtype=u) * u(0xC2B2AE3D27D4EB4F) + u(seed * 1_000_003 + tree)
    for _ in range(2):
        h = (h ^ (h >> u(31))) * u(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> u(29))) * u(0x94D049BB133111EB)
    return np.argsort(np.argsort(h ^ (h >> u(32)), axis=1), axis=1) < most


def best_cuts(sums: np.ndarray, allowed: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Per slot: feature (-1: none), cut, how much of the squared error it takes, and (statistic, slot) of both sides."""
    slots = sums.shape[1]
    left = np.cumsum(sums, axis=3)
    whole = left[..., -1:]
    right = whole - left
    with np.errstate(all="ignore"):
        part = lambda s: np.where(s[1] > 0, s[2] ** 2 / s[1], 0.0)
        own = part(whole)
        score = part(left) + part(right) - own
    good = (left[0] >= least) & (right[0] >= least) & (left[1] > 0) & (right[1] > 0) & allowed[:, :, None] & (score > 1e-12 * own)
    score = np.where(good, score, -np.inf).reshape(slots, -1)
    best = score.argmax(axis=1)
    gain = score[np.arange(slots), best]
    feature, cut = np.divmod(best, sums.shape[3])
    pick = lambda s: s.reshape(3, slots, -1)[:, np.arange(slots), best]
    found = np.isfinite(gain)
    return np.where(found, feature, -1).astype(np.int8), cut.astype(np.uint8), np.where(found, gain, 0.0), pick(left), pick(right)


def _mean(s: np.ndarray) -> np.ndarray:
    return np.divide(s[2], s[1], out=np.zeros(s.shape[1]), where=s[1] > 0)


class _Block:
    """A block's arrays in a task."""

    def __init__(self, row: dict, groups: int, n_features: int):
        self.number, self.n = row["block"], row["n"]
        self.x = np.frombuffer(row["x"], np.uint8).reshape(groups, n_features, self.n)
        self.y, self.w = np.frombuffer(row["y"]), np.frombuffer(row["w"])
        self.fold = np.frombuffer(row["fold"], np.int32)
        self.margin = np.frombuffer(row["margin"]).reshape(groups, self.n) if row["margin"] else None
        self.even = bool((self.w == 1).all())
        self.row = row

    def drawn(self, seed: int, t: int, g: int, bootstrap: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of group ``g`` that tree ``t`` draws, and how often."""
        if not bootstrap:
            rows = np.flatnonzero(self.fold != g)
            return rows, np.ones(len(rows), np.uint8)
        random = np.random.Generator(np.random.Philox(key=np.array([seed * 1_000_003 + t, self.number], np.uint64)))
        count = np.take(DRAWS, random.integers(0, 1 << 16, self.n, np.uint16)) * (self.fold != g)
        rows = np.flatnonzero(count != 0)
        return rows, count[rows]


LEVEL = "t int, part long, sums binary"
CUTS = "t int, node binary, feature binary, cut binary, gain binary, sides binary"
SUBTREE = "t int, node int, nodes binary, feature binary, cut binary, value binary, gain binary"
PART = "t int, node int, block long, x binary, count binary, y binary, w binary"


@dataclass(frozen=True)
class Forest:
    """Trees on draws with replacement, each node looking at ``most_features`` of the features."""

    numTrees: int
    maxDepth: int
    minInstancesPerNode: int
    seed: int
    most_features: int
    classes: bool

    def grow(self, blocks: DataFrame, groups: int, n_features: int, bins: int = BINS) -> tuple[Trees, np.ndarray]:
        """``groups`` times numTrees trees, and by tree and feature how much of the error it took."""
        context = blocks.sparkSession.sparkContext
        n = groups * self.numTrees
        model, gains = Trees.empty(n, self.maxDepth), np.zeros((n, n_features))
        state = np.zeros(model.feature.shape, np.int8)  # 1: to be cut by a pass, 2: by a group
        state[:, 0] = 1
        per_slot = 3 * 8 * n_features * bins
        by_groups = per_slot << (self.maxDepth - 1) > LEVEL_BYTES
        for level in range(self.maxDepth):
            if not (state == 1).any():
                break
            shared = context.broadcast((model, state))
            sums = blocks.mapInArrow(self._summed(shared, level, groups, n_features, bins), LEVEL)
            found = sums.groupBy("t").applyInArrow(self._cut(shared, level, n_features, bins), CUTS).collect()
            for r in found:
                t, node = r.t, np.frombuffer(r.node, np.int32)
                feature, cut, gain = np.frombuffer(r.feature, np.int8), np.frombuffer(r.cut, np.uint8), np.frombuffer(r.gain)
                left, right = np.frombuffer(r.sides).reshape(2, 3, len(node))
                state[t, node] = 0
                if not level:
                    model.value[t, 0] = _mean(left + right)[0]
                inner = feature >= 0
                model.feature[t, node], model.cut[t, node] = feature, cut
                np.add.at(gains[t], feature[inner], gain[inner])
                for side, s in ((1, left), (2, right)):
                    child = 2 * node[inner] + side
                    model.value[t, child] = _mean(s)[inner]
                    if level + 1 < self.maxDepth:
                        open_ = s[0][inner] >= 2 * self.minInstancesPerNode
                        small = by_groups & (s[0][inner] <= LOCAL_ROWS)
                        state[t, child] = np.where(open_, np.where(small, 2, 1), 0)
            # a tree that no task has rows of is left as it is
            state[:, : (1 << level + 1) - 1] = np.where(state[:, : (1 << level + 1) - 1] == 1, 0, state[:, : (1 << level + 1) - 1])
            shared.unpersist()
        if (state == 2).any():
            shared = context.broadcast((model, state))
            parts = blocks.mapInArrow(self._parted(shared, groups, n_features), PART)
            # stored first: an iterator alone would grow one part after the other
            for r in stage(parts.groupBy("t", "node").applyInArrow(self._finished(n_features, bins), SUBTREE), "subtrees").toLocalIterator():
                node = np.frombuffer(r.nodes, np.int32)
                feature, gain = np.frombuffer(r.feature, np.int8), np.frombuffer(r.gain)
                model.feature[r.t, node], model.cut[r.t, node] = feature, np.frombuffer(r.cut, np.uint8)
                model.value[r.t, node] = np.frombuffer(r.value)
                np.add.at(gains[r.t], feature[feature >= 0], gain[feature >= 0])
        return model, gains

    def _blocks(self, batches, groups, n_features):
        return [_Block(row, groups, n_features) for row in _rows(batches)]

    def _summed(self, shared, level, groups, n_features, bins):
        def run(batches):
            model, state = shared.value
            blocks, part = self._blocks(batches, groups, n_features), TaskContext.get().partitionId()
            first, slots = (1 << level) - 1, 1 << level
            for t in range(len(state)) if blocks else ():
                if not (state[t, first : first + slots] == 1).any():
                    continue
                g = t // self.numTrees
                total = np.zeros((3, slots, n_features, bins))
                for b in blocks:
                    rows, count = b.drawn(self.seed, t, g, self.numTrees > 1)
                    x = np.take(b.x[g], rows, axis=1)
                    at = model.places(t, x, level)
                    keep = (at >= first) & (state[t][at] == 1)
                    if not keep.all():
                        x, at, rows, count = np.compress(keep, x, axis=1), at[keep], rows[keep], count[keep]
                    count = count.astype(float)
                    w = count if b.even else count * b.w[rows]
                    total += level_sums(x, at - first, slots, count, w, w * b.y[rows], bins)
                yield _batch(LEVEL, [t], [part], [total.tobytes()])

        return run

    def _cut(self, shared, level, n_features, bins):
        def run(key, table):
            t = key[0].as_py()
            first, slots = (1 << level) - 1, 1 << level
            total = np.zeros((3, slots, n_features, bins))
            for i in np.argsort(table["part"].to_numpy()):  # in one order, or sums of doubles could differ
                total += np.frombuffer(table["sums"][int(i)].as_py()).reshape(total.shape)
            node = first + np.flatnonzero(shared.value[1][t, first : first + slots] == 1).astype(np.int32)
            allowed = _allowed(self.seed, t, node, n_features, self.most_features)
            feature, cut, gain, left, right = best_cuts(total[:, node - first], allowed, self.minInstancesPerNode)
            values = [node.astype(np.int32), feature, cut, gain, np.stack([left, right])]
            return pa.table(dict(zip(_arrow(CUTS).names, [[t], *[[v.tobytes()] for v in values]], strict=True)), _arrow(CUTS))

        return run

    def _parted(self, shared, groups, n_features):
        def run(batches):
            model, state = shared.value
            for row in _rows(batches):
                b = _Block(row, groups, n_features)
                for t in range(len(state)):
                    g = t // self.numTrees
                    rows, count = b.drawn(self.seed, t, g, self.numTrees > 1)
                    x = np.take(b.x[g], rows, axis=1)
                    at = model.places(t, x, self.maxDepth)
                    mine = np.flatnonzero(state[t][at] == 2)
                    mine = mine[np.argsort(at[mine], kind="stable")]
                    x, at, rows, count = x[:, mine], at[mine], rows[mine], count[mine]
                    start = np.flatnonzero(np.diff(at, prepend=-1))
                    ends = [*start[1:], len(at)]
                    pieces = [slice(i, j) for i, j in zip(start, ends, strict=False)] if len(at) else []
                    y, w = b.y[rows], b.w[rows]
                    columns = [[v[..., p].tobytes() for p in pieces] for v in (x, count, y, w)]
                    yield _batch(PART, [t] * len(pieces), at[start] if pieces else [], [b.number] * len(pieces), *columns)

        return run

    def _finished(self, n_features, bins):
        def run(key, table):
            t, root = key[0].as_py(), key[1].as_py()
            order = [int(i) for i in np.argsort(table["block"].to_numpy())]
            read = lambda c, kind: [np.frombuffer(table[c][i].as_py(), kind) for i in order]
            x = np.concatenate([v.reshape(n_features, -1) for v in read("x", np.uint8)], axis=1)
            count, y, w = np.concatenate(read("count", np.uint8)), np.concatenate(read("y", float)), np.concatenate(read("w", float))
            count = count.astype(float)
            w = count if (w == 1).all() else count * w
            wy = w * y
            node = np.array([root], np.int32)
            slot, done = np.zeros(x.shape[1], np.int64), []
            level = int(root + 1).bit_length() - 1
            value = np.array([wy.sum() / w.sum() if w.sum() > 0 else 0.0])
            while len(node):
                if level == self.maxDepth:
                    done.append((node, np.full(len(node), -1, np.int8), np.zeros(len(node), np.uint8), value, np.zeros(len(node))))
                    break
                sums = level_sums(x, slot, len(node), count, w, wy, bins)
                allowed = _allowed(self.seed, t, node, n_features, self.most_features)
                feature, cut, gain, left, right = best_cuts(sums, allowed, self.minInstancesPerNode)
                done.append((node, feature, cut, value, gain))
                inner = feature >= 0
                number = np.cumsum(inner) - 1
                keep = inner[slot]
                x, slot, wy, same = x[:, keep], slot[keep], wy[keep], w is count
                count, w = count[keep], w[keep]
                w = count if same else w
                right_side = x[feature[slot], np.arange(len(slot))] > cut[slot]
                slot = 2 * number[slot] + right_side
                node = (2 * node[inner][:, None] + np.array([1, 2], np.int32)).reshape(-1).astype(np.int32)
                value = np.stack([_mean(left)[inner], _mean(right)[inner]], axis=1).reshape(-1)
                level += 1
            columns = [np.concatenate(c) for c in zip(*done, strict=True)]
            node, feature, cut, value, gain = columns
            values = [[t], [root], *[[v.tobytes()] for v in (node.astype(np.int32), feature, cut, value, gain)]]
            return pa.table(dict(zip(_arrow(SUBTREE).names, values, strict=True)), _arrow(SUBTREE))

        return run

    def weights(self, groups: int) -> np.ndarray:
        return np.full(self.numTrees, 1.0 / self.numTrees)

    def importances(self, gains: np.ndarray) -> np.ndarray:
        return _shares(_shares(gains).sum(axis=0))

    def of_group(self, g: int) -> slice:
        return slice(g * self.numTrees, (g + 1) * self.numTrees)


@dataclass(frozen=True)
class Boosted:
    """Trees on the residuals of the logistic loss, round after round; labels are 0 or 1, rows weigh the same."""

    maxIter: int
    maxDepth: int
    stepSize: float
    seed: int
    minInstancesPerNode: int = 1
    classes: bool = True

    def grow(self, blocks: DataFrame, groups: int, n_features: int, bins: int = BINS) -> tuple[Trees, np.ndarray]:
        """maxIter trees for each group, group after group, and by tree and feature how much of the error it took."""
        context = blocks.sparkSession.sparkContext
        model, gains = Trees.empty(groups * self.maxIter, self.maxDepth), np.zeros((groups * self.maxIter, n_features))
        stored = 0  # rounds that the blocks' margins hold
        every = np.ones((1, n_features), bool)
        for m in range(self.maxIter):
            if m - stored == KEPT_ROUNDS:
                shared = context.broadcast(model)
                blocks = stage(blocks.mapInArrow(self._moved(shared, stored, m, groups, n_features), BLOCK), "margins")
                shared.unpersist()
                stored = m
            trees = [g * self.maxIter + m for g in range(groups)]
            open_ = {t: np.array([0], np.int32) for t in trees}
            for level in range(self.maxDepth):
                if not any(len(v) for v in open_.values()):
                    break
                recent = {g: [g * self.maxIter + i for i in range(stored, m + 1)] for g in range(groups)}
                part = Trees(*[np.concatenate([a[recent[g]] for g in range(groups)]) for a in (model.feature, model.cut, model.value)])
                shared = context.broadcast((part, [open_[t] for t in trees]))
                total = {}
                summed = blocks.mapInArrow(self._summed(shared, level, stored, m, groups, n_features, bins), LEVEL).collect()
                for r in sorted(summed, key=lambda r: (r.t, r.part)):  # sums of a few nodes, as many as tasks
                    total[r.t] = total.get(r.t, 0.0) + np.frombuffer(r.sums).reshape(3, -1, n_features, bins)
                shared.unpersist()
                for g, t in enumerate(trees):
                    node, open_[t] = open_[t], np.array([], np.int32)
                    if g not in total:
                        continue
                    feature, cut, gain, left, right = best_cuts(total[g], np.repeat(every, len(node), axis=0), self.minInstancesPerNode)
                    if not level:
                        model.value[t, 0] = _mean(left + right)[0]
                    inner = feature >= 0
                    model.feature[t, node], model.cut[t, node] = feature, cut
                    np.add.at(gains[t], feature[inner], gain[inner])
                    for side, s in ((1, left), (2, right)):
                        model.value[t, 2 * node[inner] + side] = _mean(s)[inner]
                        more = (s[0] >= 2 * self.minInstancesPerNode) & inner
                        open_[t] = np.append(open_[t], 2 * node[more] + side).astype(np.int32)
        return model, gains

    def _steps(self, start: int, stop: int) -> list[float]:
        return [self.stepSize if i else 1.0 for i in range(start, stop)]

    def _summed(self, shared, level, stored, m, groups, n_features, bins):
        def run(batches):
            model, open_ = shared.value
            part, total = TaskContext.get().partitionId(), {}
            kept = m - stored + 1  # the last one is being grown
            for row in _rows(batches):
                b = _Block(row, groups, n_features)
                for g in range(groups):
                    if not len(open_[g]):
                        continue
                    slot_of = np.full(1 << level, -1, np.int64)
                    slot_of[open_[g] - (1 << level) + 1] = np.arange(len(open_[g]))
                    x = b.x[g]
                    slot = slot_of[model.reached(g * kept + kept - 1, x, level)]
                    mine = np.flatnonzero((slot >= 0) & (b.fold != g))
                    if not len(mine):
                        continue
                    margin = b.margin[g].copy()
                    for i, step in enumerate(self._steps(stored, m)):
                        margin += step * model.values(g * kept + i, x)
                    sign = 2.0 * b.y[mine] - 1.0
                    left = sign if m == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin[mine]))
                    sums = level_sums([v[mine] for v in x], slot[mine], len(open_[g]), None, None, left, bins)
                    total[g] = total.get(g, 0.0) + sums
            for g, sums in total.items():
                yield _batch(LEVEL, [g], [part], [sums.tobytes()])

        return run

    def _moved(self, shared, stored, m, groups, n_features):
        def run(batches):
            model = shared.value
            for row in _rows(batches):
                b = _Block(row, groups, n_features)
                margin = b.margin.copy()
                for g in range(groups):
                    for i, step in zip(range(stored, m), self._steps(stored, m), strict=True):
                        margin[g] += step * model.values(g * self.maxIter + i, b.x[g])
                yield pa.RecordBatch.from_pylist([{**row, "margin": margin.tobytes()}], _arrow(BLOCK))

        return run

    def weights(self, groups: int) -> np.ndarray:
        return np.array(self._steps(0, self.maxIter))

    def importances(self, gains: np.ndarray) -> np.ndarray:
        return _shares(gains.sum(axis=0))

    def of_group(self, g: int) -> slice:
        return slice(g * self.maxIter, (g + 1) * self.maxIter)


def _shares(gains: np.ndarray) -> np.ndarray:
    total = gains.sum(axis=-1, keepdims=True)
    return np.divide(gains, total, out=np.zeros_like(gains), where=total > 0)


@dataclass
class Grown:
    """A fitted ensemble."""

    features: list[str]
    method: Forest | Boosted
    at: list[np.ndarray]
    trees: Trees
    weights: np.ndarray
    importances: np.ndarray = field(repr=False)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with prediction and, of classes, their probability."""
        shared = df.sparkSession.sparkContext.broadcast((self.at, self.trees, self.weights))
        boosted = isinstance(self.method, Boosted)

        @F.pandas_udf("double")
        def value(*columns):
            import pandas as pd

            at, trees, weights = shared.value
            rows = np.stack([c.to_numpy(float) for c in columns])
            if np.isnan(rows).any():
                raise ValueError("a feature is missing")
            x = _bins(rows, at)
            found = np.zeros(x.shape[1])
            for t, weight in enumerate(weights):
                found += weight * trees.values(t, x)
            return pd.Series(1.0 / (1.0 + np.exp(-2.0 * found)) if boosted else found)

        found = value(*[F.col(f).cast("double") for f in self.features])
        if not self.method.classes:
            return df.withColumn("prediction", found)
        scored = df.withColumn("_p", found)
        p = F.col("_p")
        return scored.withColumns({"probability": array_to_vector(F.array(1 - p, p)), "prediction": (p > 0.5).cast("double")}).drop("_p")


@dataclass(frozen=True)
class Grower:
    """A :class:`Forest` or :class:`Boosted`, unfitted, on given columns."""

    features: list[str]
    label: str
    method: Forest | Boosted
    weight: str | None = None

    def fit(self, df: DataFrame) -> Grown:
        return self.fit_folds(df, None, 1)[0]

    def fit_folds(self, df: DataFrame, fold: str | None, k: int) -> list[Grown]:
        """A model for each fold, of the rows outside it; without ``fold`` one of all rows."""
        raw = packed(df, self.features, self.label, self.weight, fold)
        at = cuts(raw, k, len(self.features))
        blocks = binned(raw, at, isinstance(self.method, Boosted))
        model, gains = self.method.grow(blocks, k, len(self.features))
        out = []
        for g in range(k):
            own = self.method.of_group(g)
            trees = Trees(model.feature[own], model.cut[own], model.value[own])
            out.append(Grown(self.features, self.method, at[g], trees, self.method.weights(k), self.method.importances(gains[own])))
        return out
