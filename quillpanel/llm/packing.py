"""Packing documents into fixed windows by repeat counts of length combinations.

Each document is cut into whole windows and a rest.  Rests are binned by length; every shallow
combination of bins that fills the window is a column of a small matrix, and non-negative least squares
finds how often to repeat each so that the histogram of the rests is used up.  The counts are rounded
down, sequences are laid out, and the rests left over are packed greedily: first into the gaps of those
sequences, then into windows of their own, cut where a window ends.  What is left at the very end of a
block fills sequences whose sizes are powers of two, so nothing is padded.

Packing runs inside the tasks that encode, over blocks of a bounded number of tokens; no row moves.
Only one number per task, its sequences, is added up afterwards to number sequences over all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel.llm.batches import column, in_batches, slices
from quillpanel.llm.encoding import ENCODED_BYTES, ENCODED_ROWS, ENCODER, END_ID, worker_encoder
from quillpanel.session import stage

WINDOW = 2048
BINS = 32
DEPTH = 4
BLOCK_TOKENS = 4_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, part_sequence long, offset long"


def combinations(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """All ways to write ``bins`` as a sum of at most ``depth`` bin sizes, as columns of uses per bin size 1..bins."""

    def ways(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif parts:
            for size in range(min(left, most), 0, -1):
                for rest in ways(left - size, size, parts - 1):
                    yield (size, *rest)

    found = list(ways(bins, bins, depth))
    matrix = np.zeros((bins, len(found)))
    for k, sizes in enumerate(found):
        np.add.at(matrix[:, k], np.array(sizes) - 1, 1)
    return matrix


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with least ||a x - b||, by the active-set method: columns enter by gradient, leave at zero."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[1]):
        gradient = np.where(inside, -np.inf, a.T @ (b - a @ x))
        best = int(gradient.argmax())
        if gradient[best] <= tolerance:
            break
        inside[best] = True
        while True:
            z = np.zeros_like(x)
            z[inside] = np.linalg.lstsq(a[:, inside], b, rcond=None)[0]
            low = inside & (z <= 0)
            if not low.any():
                break
            step = float((x[low] / np.maximum(x[low] - z[low], 1e-300)).min())
            x += step * (z - x)
            inside &= x > 1e-12
            x[~inside] = 0
        if not inside[best]:  # it can't enter without leaving at once
            break
        x = z
    return x


def repeat_counts(histogram: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Whole repeat counts that use no bin more often than it occurs."""
    counts = np.floor(nnls(matrix, histogram.astype(float)) + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for k in np.argsort(-counts, kind="stable"):
        used = matrix[:, k] > 0
        counts[k] = min(counts[k], int((left[used] // matrix[used, k].astype(np.int64)).min()))
        left -= counts[k] * matrix[:, k].astype(np.int64)
    return counts


def layout(rests: np.ndarray, matrix: np.ndarray, window: int = WINDOW):
    """Places for pieces of the lengths ``rests`` (1..window-1 each).

    Returns arrays (piece, begin within it, length, sequence, offset) and the number of sequences.
    """
    bins = len(matrix)
    width = window // bins
    size = -(-rests // width)
    order = np.lexsort((np.arange(len(rests)), -rests, size))  # in a bin the longest first
    first = np.searchsorted(size[order], np.arange(1, bins + 2))
    counts = repeat_counts(np.diff(first), matrix)
    taken, chosen = first[:-1].copy(), []
    for k in np.flatnonzero(counts):
        n, slots = int(counts[k]), []
        for b in np.flatnonzero(matrix[:, k])[::-1]:
            for _ in range(int(matrix[b, k])):
                slots.append(order[taken[b] : taken[b] + n])
                taken[b] += n
        chosen += list(np.stack(slots, axis=1))
    placed = np.zeros(len(rests), bool)
    gaps = np.array([window - int(rests[c].sum()) for c in chosen], np.int64)
    for c in chosen:
        placed[c] = True
    # Gaps are filled from the rest; sequences with the largest gaps are given up if that has too few tokens.
    wide = np.argsort(-gaps, kind="stable")
    spare = int(rests[~placed].sum()) + np.concatenate([[0], np.cumsum(window - gaps[wide])])
    wanted = int(gaps.sum()) - np.concatenate([[0], np.cumsum(gaps[wide])])
    given = int(np.argmax(spare >= wanted))
    for k in wide[:given]:
        placed[chosen[k]] = False
    kept = [chosen[k] for k in sorted(wide[given:])]
    out, holes = [], []
    for sequence, c in enumerate(kept):
        ends = np.cumsum(rests[c])
        out += [(p, 0, int(rests[p]), sequence, int(e - rests[p])) for p, e in zip(c, ends, strict=True)]
        if ends[-1] < window:
            holes.append((window - int(ends[-1]), sequence, int(ends[-1])))
    sequences = len(kept)
    loose = np.flatnonzero(~placed)
    loose = loose[np.argsort(-rests[loose], kind="stable")]
    total = int(rests[loose].sum()) - sum(h[0] for h in holes)
    sizes = [window] * (total // window) + [1 << k for k in range(window.bit_length() - 2, -1, -1) if (total % window) >> k & 1]
    holes += [(s, sequences + k, 0) for k, s in enumerate(sizes)]
    sequences += len(sizes)
    if holes:
        h = np.array(holes, np.int64)
        pieces_at = np.concatenate([[0], np.cumsum(rests[loose])])
        holes_at = np.concatenate([[0], np.cumsum(h[:, 0])])
        cuts = np.unique(np.concatenate([pieces_at, holes_at]))
        lengths = np.diff(cuts)
        p = np.searchsorted(pieces_at, cuts[:-1], "right") - 1
        q = np.searchsorted(holes_at, cuts[:-1], "right") - 1
        out += zip(
            loose[p].tolist(),
            (cuts[:-1] - pieces_at[p]).tolist(),
            lengths.tolist(),
            h[q, 1].tolist(),
            (h[q, 2] + cuts[:-1] - holes_at[q]).tolist(),
            strict=True,
        )
    return out, sequences


def _packer(path: str, end_id: int, window: int, block_tokens: int, keep_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sequence = worker_encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        matrix = combinations()
        block: list[tuple[int | None, bytes]] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for d, (_, ids) in enumerate(block):
                for begin in range(0, len(ids) // 4 // window):
                    rows.append((d, begin * window, window, sequence, 0))
                    sequence += 1
            n = np.array([len(ids) // 4 for _, ids in block], np.int64)
            owner = np.flatnonzero(n % window)
            if len(owner):
                places, used = layout(n[owner] % window, matrix, window)
                for p, begin, length, s, offset in places:
                    d = int(owner[p])
                    rows.append((d, int(n[d] // window * window + begin), length, sequence + s, offset))
                sequence += used
            views = [memoryview(ids) for _, ids in block]
            crc = [zlib.crc32(views[d][4 * b : 4 * (b + k)]) for d, b, k, _, _ in rows]
            doc, begin, length, seq, offset = map(np.array, zip(*rows, strict=True))
            columns = [
                pa.array([block[d][0] for d in doc], pa.int64()),
                *(pa.array(x, pa.int64()) for x in (begin, length, crc, n[doc])),
                pa.array(np.full(len(rows), part, np.int32)),
                *(pa.array(x, pa.int64()) for x in (seq, offset)),
            ]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if keep_ids:
                pieces = [views[d][4 * b : 4 * (b + k)] for d, b, k, _, _ in rows]
                at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(pieces), "<i4"))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in slices(batches, ENCODED_ROWS, ENCODED_BYTES, keep=ENCODER):
            every, at = encoder.encode_all(batch.column(batch.schema.get_field_index("text")))
            for doc, a, b in zip(column(batch, "doc_id"), at[:-1], at[1:], strict=True):
                ids = every[a:b].astype("<u4").tobytes() + end
                block.append((doc, ids))
                tokens += len(ids) // 4
                if tokens >= block_tokens:
                    yield packed()
                    block, tokens = [], 0
        if block:
            yield packed()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    window: int = WINDOW,
    block_tokens: int = BLOCK_TOKENS,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) and their places in sequences of at most ``window`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids with ``keep_ids``.
    Every row is a document of its own, also where a doc_id repeats or is null; a null or empty text is
    the end id alone; other columns are ignored; an empty table gives no pieces.  Sequences hold exactly
    ``window`` tokens, but for a few at the end of each block whose sizes are powers of two.
    ``window`` must be a power of two of at least the number of bins.
    """
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    pieces = stage(
        in_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _packer(tokenizer, end_id, window, block_tokens, keep_ids), schema
        ),
        "pieces",
    )
    totals = pieces.groupBy("part").agg((F.max("part_sequence") + 1).alias("n"))  # a row per task
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return pieces.join(F.broadcast(bases), "part").select(
        *["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
        (F.col("base") + F.col("part_sequence")).alias("sequence_id"),
        "offset",
        *(["ids"] if keep_ids else []),
    )
