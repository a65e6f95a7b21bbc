"""Components against all pairs, signatures against their definition."""

import random

import numpy as np
import pyarrow as pa

from fixtures import documents, empty, frame, prose
from quillpanel.llm import minhash
from quillpanel.llm.components import components
from quillpanel.llm.words import shingle_sets, space_table


def sets_of(rows):
    out = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def plain_components(rows):
    sets, root = sets_of(rows), list(range(len(rows)))
    top = lambda i: i if root[i] == i else top(root[i])
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[top(i)] = min(best.get(top(i), r[0]), r[0])
    return [(r[0], len(s), best.get(top(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def chains(n=140):
    """Copies of copies and copies of one template, at similarities on both sides of the threshold."""
    r = random.Random(8)
    rows = [(1000 + i, t, "en", "a", 0, 7, "x", 1, "own", 2, "y") for i, t in enumerate([prose(7, 200), prose(8, 40), prose(9, 9)])]
    for i in range(n):
        source = rows[r.choice([0, 1, 2, r.randrange(len(rows))])][1].split()
        for _ in range(r.randint(0, max(1, len(source) // 30))):
            source[r.randrange(len(source))] = prose(r.random(), 1)
        rows.append((r.choice([500, 2000]) + i, " ".join(source), "en", "a", 0, 7, "x", 1, "own", 2, "y"))
    return rows


def test_components_are_those_of_all_pairs(spark):
    for rows in (documents(), chains()):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_copies(frame(spark, rows)).collect()), key=str)
        assert got == sorted(plain_components(rows), key=str)
    assert minhash.near_copies(empty(spark)).count() == 0


def test_what_stars_leave_open(spark, monkeypatch):
    """A centre unlike its bucket, and tiles smaller than the bucket."""
    monkeypatch.setattr(minhash, "TILE", 7)
    rows = chains(60)
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_copies(frame(spark, rows)).collect())
    assert got == sorted((d, c) for d, _, c in plain_components(rows))


def test_one_row_of_each_group_stays(spark):
    df = frame(spark)
    got = minhash.without_copies(df)
    assert got.columns == df.columns
    found = plain_components(documents())
    expected = {d for d, _, c in found if d is not None and d == c}
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(expected) and ids.count(None) == 2
    assert minhash.without_copies(empty(spark)).count() == 0


def test_signatures():
    edges, probes = np.array([(b << 64) // minhash.BINS for b in range(minhash.BINS)], np.uint64), minhash.probe_table()
    rng = np.random.default_rng(1)
    for n in (1, 3, 5000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        got = minhash.signature(s, edges, probes)
        bins = np.array([int(h) * minhash.BINS >> 64 for h in s])
        least = {b: s[bins == b].min() for b in set(bins.tolist())}
        assert all(got[b] == v for b, v in least.items()) and set(got.tolist()) == {int(v) for v in least.values()}


def tile_row(node, s):
    return (1, 0, 0, 0, node, node, 0, 1, [7] * minhash.BANDS, minhash.sketch(s))


def compared(rows):
    names = ["key", "i", "j", "tile", "node", "comp", "band", "centre", "bands", "sketch"]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names)
    return sorted(tuple(r.values()) for out in minhash._compare(75)([batch]) for r in out.to_pylist())


def test_tiles_lose_no_pair_of_any_length():
    """All pairs of a tile, of sets from 1 to 3000 shingles on both sides of the threshold and of SKETCH."""
    rng = np.random.default_rng(2)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    sets = []
    for n in (1, 4, 20, 395, 404, 420, 536, 900, 3000):
        whole = draw(n)
        sets.append(whole)
        for share in (0.70, 0.75, 0.76, 0.80, 0.97):  # a subset's similarity is its share
            sets.append(np.sort(rng.permutation(whole)[: max(1, -int(-share * n // 1))]))
        other = draw(max(1, n // 7))  # as many foreign shingles in place of own ones: similarity 0.75
        sets.append(np.union1d(rng.permutation(whole)[len(other) :], other))
    pairs = [(a + 2, b + 2) for b in range(len(sets)) for a in range(b) if minhash.linked(sets[a], sets[b])]
    got = compared([tile_row(n + 2, s) for n, s in enumerate(sets)])
    assert set(pairs) <= set(got) and len(got) < len(pairs) + 60 and len(pairs) > 60


def test_sketches():
    big = np.zeros(70_000, np.uint64)  # a cell beyond what two bytes count
    size, low, cells = minhash.opened(minhash.sketch(big))
    assert size == 70_000 and not len(low) and cells[0] >= 70_000
    for n in (0, 1, minhash.SKETCH, minhash.SKETCH + 1):
        s = np.arange(n, dtype=np.uint64) * np.uint64(97)
        size, low, cells = minhash.opened(minhash.sketch(s))
        assert size == n == cells.sum() and len(low) == (n if n <= minhash.SKETCH else 0)
        assert (cells == np.bincount((s % np.uint64(1024)).astype(int), minlength=1024)).all()


def test_long_sets_of_one_bucket(spark, monkeypatch):
    """Texts of 404 to 900 words around the threshold, whose centre is unlike them."""
    monkeypatch.setattr(minhash, "TILE", 5)
    r, rows = random.Random(4), []
    for words in (404, 536, 900):
        base = prose(words, words).split()
        for k in range(8):
            copy = list(base)
            for at in range(3, len(copy), max(5, 38 + k)):
                copy[at] = prose(r.random(), 1)
            rows.append((words * 10 + k, " ".join(copy), "en", "a", 0, 7, "x", 1, "own", 2, "y"))
    got = sorted((x.doc_id, x.component_id) for x in minhash.near_copies(frame(spark, rows)).collect())
    assert got == sorted((d, c) for d, _, c in plain_components(rows))


def test_shingles_lower_only_ascii():
    a, b, c = shingle_sets([t.lower() for t in ("A B\tC d E é".encode(), "a b c D e é".encode(), "a b c d e É".encode())], space_table())
    assert (a == b).all() and len(a) == 2 and len(np.intersect1d(a, c)) == 1
    assert not minhash.linked(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def test_components_of_links(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 100), (7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 90: 90, 100: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
