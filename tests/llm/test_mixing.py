"""Targets against plain sharing, permutations, and the words that are taken."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fixtures import documents, empty, frame, prose
from quillpanel.llm import mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            free.remove(s)


def test_mix(spark):
    rows = documents() + [(1000 + i, prose(i, 400), "en", ["a", "b", "ü"][i % 3], 0, 7, "x", 1, "own", 2, "y") for i in range(60)]
    got = mixing.mix(frame(spark, rows)).collect()
    words = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    targets, source, taken = plain_targets(sizes), {r[0]: r[3] for r in rows}, defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size
        if r.doc_id is not None:
            assert abs(r.target - targets[source[r.doc_id]]) < 1e-5 and r.source_size == sizes[source[r.doc_id]]
            taken[source[r.doc_id]] += r.taken
    for s in ("b", "ü"):
        assert abs(taken[s] - targets[s]) < 0.05 * targets[s] + 200
    again = mixing.mix(frame(spark, rows).repartition(5)).collect()
    pairs = lambda x: Counter((r.doc_id, r.size, r.taken) for r in x)
    assert pairs(got) == pairs(again)
    assert mixing.mix(empty(spark)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 3, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(12345).cast("long")).alias("p"))
        moved = [r.p for r in df.collect()]
        assert sorted(moved) == list(range(n)) and (n < 64 or sum(i == m for i, m in enumerate(moved)) < 8)


def test_counts_are_multinomial(spark):
    """Totals are as wanted; over shards a source's counts vary as a multinomial draw's do."""
    wanted = [700, 20_000, 80_000, 3_300, 96_000]
    rows = [(k + 1, w, sum(wanted[: k + 1]), sum(wanted)) for k, w in enumerate(wanted)]
    df = spark.createDataFrame(rows, "k long, wanted long, upto long, slots long")
    counts, size = defaultdict(Counter), 500
    for r in mixing.shard_counts(df, size).collect():
        counts[r.k][r.shard] = r["count"]
    shards = sum(wanted) // size
    assert [sum(counts[k + 1].values()) for k in range(5)] == wanted
    assert all(sum(counts[k][s] for k in counts) == size for s in range(shards))
    for k, w in enumerate(wanted):
        p = w / sum(wanted)
        own = [counts[k + 1][s] for s in range(shards)]
        variance = sum((n - size * p) ** 2 for n in own) / shards
        assert 0.75 < variance / (size * p * (1 - p)) < 1.3


def test_sources_get_their_targets(spark):
    """To a block, also those that stop at twice their size; repeated and null ids are spread."""
    rows = [(None if i % 3 == 0 else i % 50, prose(i % 90, 300), "en", "abc"[(i % 20 > 0) + (i % 20 > 2)], 0, 7, "x", 1, "own", 2, "y") for i in range(1500)]
    taken, target = Counter(), {}
    for r in mixing.mix(frame(spark, rows)).collect():
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(target) == 3 and sum(target[s] == 2 * s for s in target) >= 1
    for size, words in taken.items():
        assert abs(words - target[size]) <= 3 * mixing.BLOCK
        assert target[size] < 2 * size or words == 2 * size


def test_mixed_documents(spark):
    rows = [(i, prose(i, 150), "en", ["a", "b", "ü", None][i % 4], 0, 7, "x", 1, "own", 2, "y") for i in range(40)]
    rows += [(50, None, None, "a", 1, 7, "x", 1, "own", 2, "y"), (51, "", None, None, 1, 7, "x", 1, "own", 2, "y")]
    plan = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows)).collect()}
    got = mixing.mixed_documents(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    text = {r[0]: r[1] for r in rows}
    seen = {}
    for r in got.collect():
        seen[r.doc_id] = len(r.text.split())
        assert r.n_chars == len(r.text) and (r.row, r.size, r.own) == (7, "x", "y")
        assert set(r.text.split()) <= set(text[r.doc_id].split())
    assert seen == {d: n for d, n in plan.items() if n}
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_shared_steps_are_planned_once(spark, sf_dir):
    """Steps that several branches read are stored: the plan that the driver holds stays small."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for out in (mixing.mixed_documents(docs), mixing.mix(docs)):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 25
