"""Mixing sources to target weights, with built-in functions only.

The words of each source, document after document, form a stream that is cut into blocks of a fixed
number of words.  The mix is a row of output shards, each with a fixed number of slots.  Every shard
draws how many of its slots each source gets: multinomial counts, from one uniform number a slot.  Summed
over shards a source then has some slots more or less than its target asks for; what is too much, spread
over its shards, is drawn again among the sources that lack slots, so that totals are as wanted and no
slot is lost.  The slots that a source got are numbered through all shards, and a pseudorandom
permutation of the source's block numbers, a new one for each pass over the source, says which block a
slot takes.  Slots and blocks meet in a join on (source, block number).

All random numbers are integer arithmetic on (seed, source, shard or pass): reruns agree, whatever the
partitioning.  A hot source never meets in one task: running sums are taken in buckets of documents or
shards first, and the join's key has the block number in it.  Rows of equal id and size are one entry of
the stream with a count, so that no repeated id crowds a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel.llm.batches import quoted
from quillpanel.llm.text_columns import whole, words
from quillpanel.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD_SLOTS = 8192
SEED = 20240917
BUCKET_DOCS = 4096
CHUNK_SHARDS = 4096
ROUNDS = 12
PRIME = 2147483647


def hashed(value: Column, salt: Column) -> Column:
    """A pseudorandom whole number below PRIME; ``value`` below 2**46, ``salt`` below 2**31."""
    p = F.lit(PRIME).cast("long")
    a = (value * F.lit(48271).cast("long") + salt) % p
    b = (a * a + salt) % p
    c = (b * b + a) % p
    return (c * F.lit(69621).cast("long") + b) % p


def _round(number: int) -> tuple[int, int, int]:
    """The constants of a round: powers of three numbers modulo PRIME."""
    return tuple(pow(g, number + 4, PRIME) for g in (48271, 69621, 16807))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Position ``x`` of 0..n-1 under the permutation that ``key`` (below PRIME) names; n below 2**46.

    Swap-or-not: each round pairs x with (k - x) mod n for the round's k, and a pseudorandom bit of the
    pair, from :func:`hashed`, says whether to swap, which is a permutation for any n.
    """
    p = F.lit(PRIME).cast("long")
    long = lambda v: F.lit(v).cast("long")
    constants = F.array(*[F.struct(*[long(v).alias(c) for c, v in zip("abs", _round(r), strict=True)]) for r in range(1, rounds + 1)])

    def bit(value: Column, salt: Column) -> Column:
        last = lambda b, c: (c * long(69621) + b) % p
        third = lambda a, b: _let((b * b + a) % p, lambda c: last(b, c))
        return _let((value * long(48271) + salt) % p, lambda a: _let((a * a + salt) % p, lambda b: third(a, b))).bitwiseAND(1024) != 0

    def one(at: Column, c: Column) -> Column:
        swap = lambda other: _let((key + c["s"]) % p, lambda salt: F.when(bit(F.greatest(at, other), salt), other).otherwise(at))
        return _let((key * c["a"] + c["b"] + n - at) % n, swap)

    return F.aggregate(constants, x, one)


def sums_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows of ``group``, by ``bucket`` and then ``order``.

    Rows are summed within a bucket, and buckets' totals within the group, so a task holds one bucket.
    """
    inner = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    ahead = totals.select(*group, bucket, F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_ahead"))
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(ahead, [*group, bucket]).withColumn(out, F.col("_ahead") + F.col("_within")).drop("_ahead", "_within")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row per source of ``sizes`` (source, size): k, source, n_docs, source_size, target.

    Sources by code point, null last, have the ``weights`` in turn.  Targets share ``share`` times all
    sizes by weight; a target stops at ``most`` times its source's size and the excess is shared again,
    which is the largest level that any prefix of the sources, by cap over weight, leaves for the others.
    """
    # One row per source; a mix names its sources, so these windows are over a short list.
    totals = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size")
    )
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    every = W.partitionBy(F.lit(1))
    before = W.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(W.unboundedPreceding, -1)
    left = lambda total, c: total - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    return (
        totals.withColumn("k", k.cast("long"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("all_target", F.sum("source_size").over(every) * float(share))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("level", left(F.col("all_target"), "cap") / left(F.col("all_weight"), "weight"))
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.round(F.least("cap", F.col("level") * F.col("weight")), 6))
        .select("k", "source", "n_docs", "source_size", "target")
    )


def wanted_slots(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """k, n_blocks, wanted (slots), upto (slots of this source and those before it), slots (all), per source with words."""
    # A slot is one block; the last block of a source is shorter, which the expected number allows for.
    blocks = targets.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    blocks = blocks.withColumn("wanted", F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))
    upto = F.sum("wanted").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0))  # a row per source
    return blocks.select("k", "n_blocks", "wanted", upto.alias("upto"), F.sum("wanted").over(W.partitionBy(F.lit(1))).alias("slots"))


def _share_no(bounds: Column, x: Column) -> Column:
    """1 + the number of the ascending ``bounds`` that are not above ``x``."""
    return (F.size(F.filter(bounds, lambda b: b <= x)) + 1).cast("long")


def shard_counts(wanted: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """chunk, shard, k, count: how many slots of each shard a source gets; sources are numbered 1, 2, ... without gaps.

    Multinomial counts by ``wanted`` (of :func:`wanted_slots`), then draws beyond a source's total are drawn
    again among the sources that have too few.
    """
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.floor(F.col("upto") / F.col("slots") * PRIME).cast("long")
    bounds = wanted.agg(F.max("slots").alias("slots"), F.array_sort(F.collect_list(share)).alias("bounds"))  # a number per source
    last_chunk = F.floor((F.col("slots") - 1) / (shard_slots * CHUNK_SHARDS)).cast("long")
    chunks = bounds.where("slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)).alias("chunk")).repartition(tasks, "chunk")
    last_shard = F.least((F.col("chunk") + 1) * CHUNK_SHARDS - 1, F.floor((F.col("slots") - 1) / shard_slots)).cast("long")
    shards = chunks.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK_SHARDS, last_shard)).alias("shard")).repartition(tasks, "shard")
    n = F.least(F.lit(shard_slots).cast("long"), F.col("slots") - F.col("shard") * shard_slots)
    salt = (F.lit(seed).cast("long") + F.col("shard") * 7919) % PRIME
    drawn = shards.select("bounds", "chunk", "shard", salt.alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("slot"))
    drawn = drawn.select("chunk", "shard", "bounds", hashed(F.col("slot"), F.col("salt")).alias("u"))
    # the last bound is above every number
    drawn = drawn.select("chunk", "shard", _share_no(F.slice("bounds", 1, F.size("bounds") - 1), F.col("u")).alias("k"))
    drawn = stage(drawn.groupBy("chunk", "shard", "k").agg(F.count(F.lit(1)).alias("count")), "drawn")

    totals = wanted.join(drawn.groupBy("k").agg(F.sum("count").alias("got")), "k", "left").select("k", "wanted", F.coalesce("got", F.lit(0)).alias("got"))
    totals = totals.withColumn("more", F.greatest(F.lit(0), F.col("got") - F.col("wanted"))).withColumn("less", F.greatest(F.lit(0), F.col("wanted") - F.col("got")))
    totals = stage(totals.withColumn("lacking", F.sum("less").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0))), "totals")
    # what a source has too much is given up evenly along its running count, so by all of its shards
    counted = sums_before(drawn.join(F.broadcast(totals.where("more > 0").select("k", "got", "more")), "k"), ["k"], "chunk", [F.col("shard")], "count", "before")
    along = lambda at: F.floor(F.col("more") * (at / F.col("got"))).cast("long")
    given = counted.select("chunk", "shard", "k", (along(F.col("before") + F.col("count")) - along(F.col("before"))).alias("given")).where("given > 0")
    given = stage(given, "given")
    void = given.groupBy("chunk", "shard").agg(F.sum("given").alias("void")).withColumn("one", F.lit(1))
    void = sums_before(void, ["one"], "chunk", [F.col("shard")], "void", "before")
    lacking = totals.agg(F.struct(F.max("lacking").alias("n"), F.array_sort(F.collect_list("lacking")).alias("bounds"))).scalar()  # a number per source
    again = void.withColumn("lacking", lacking).select("chunk", "shard", "lacking.n", "lacking.bounds", F.explode(F.sequence("before", F.col("before") + F.col("void") - 1)).alias("place"))
    again = again.select("chunk", "shard", "bounds", permuted(F.col("place"), F.col("n"), F.lit(seed % PRIME).cast("long")).alias("place"))
    again = again.select("chunk", "shard", _share_no(F.col("bounds"), F.col("place")).alias("k"))
    changes = again.groupBy("chunk", "shard", "k").agg(F.count(F.lit(1)).alias("count"))
    changes = changes.union(given.select("chunk", "shard", "k", -F.col("given")))
    return drawn.union(changes).groupBy("chunk", "shard", "k").agg(F.sum("count").alias("count")).where("count > 0")


def drawn_blocks(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each block: k, block, times; blocks not drawn are absent."""
    number = F.row_number().over(W.orderBy("k")).cast("long")  # a row per source
    wanted = stage(wanted_slots(targets, block).where("wanted > 0").withColumn("own", F.col("k")).withColumn("k", number), "wanted")
    # stored, as running sums read it twice: the driver plans a stored table, not all that leads to it, each time
    counts = stage(shard_counts(wanted, shard_slots, seed), "counts")
    names = wanted.select(F.col("k").alias("no"), F.col("own").alias("k"), "n_blocks")
    counts = counts.withColumnRenamed("k", "no").join(names, "no").select("k", "n_blocks", "chunk", "shard", "count")
    counts = sums_before(counts, ["k", "n_blocks"], "chunk", [F.col("shard")], "count", "first")
    # A few small rows make many slots: dealt out by number, or they would be put together in one task.
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = counts.repartition(tasks, "k", "shard").select(
        "k", "n_blocks", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("i")
    )
    turn = F.floor(F.col("i") / F.col("n_blocks")).cast("long")
    key = (F.lit(seed).cast("long") + F.col("k") * 104729 + turn * 1299709) % PRIME
    slots = slots.select("k", "n_blocks", key.alias("key"), (F.col("i") % F.col("n_blocks")).alias("block"))
    place = permuted(F.col("block"), F.col("n_blocks"), F.col("key"))
    return slots.select("k", place.alias("block")).groupBy("k", "block").agg(F.count(F.lit(1)).alias("times"))


def stream_places(rows: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, size, k, n_docs) with ``begin``, the words before each row in its source's stream.

    The stream is ordered by bucket of doc_id, doc_id (nulls first) and size.  Rows that agree in these are
    counted first and lie one after the other, by row within their input partition and then by that.
    """
    buckets = F.ceil(F.col("n_docs") / BUCKET_DOCS).cast("long")
    known, doc = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = rows.select("*", F.pmod(doc, buckets).alias("bucket"), known.alias("known"), doc.alias("doc"))
    entry = ["k", "bucket", "known", "doc", "size"]
    # entries and places are stored, as each is read more than once: see drawn_blocks
    entries = stage(rows.groupBy(*entry).agg(F.count(F.lit(1)).alias("copies")), "entries")
    order = [F.col("known"), F.col("doc"), F.col("size")]
    entries = sums_before(entries.withColumn("words", F.col("size") * F.col("copies")), ["k"], "bucket", order, "words", "begin")
    placed = stage(rows.join(entries.select(*entry, "copies", "begin"), entry), "placed")
    out = ["row", "doc_id", "size", "k", "begin"]
    again = placed.where("copies > 1").withColumn("part", F.shiftright("row", 33))
    again = sums_before(again, [*entry, "begin"], "part", [F.col("row")], "size", "ahead")
    return placed.where("copies = 1").select(*out).union(again.withColumn("begin", F.col("begin") + F.col("ahead")).select(*out))


def taken_ranges(rows: DataFrame, block: int = BLOCK, **options) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` (row, doc_id, source, size): the placed rows, and their parts with how often each is taken.

    Placed: row, doc_id, size, source_size, target.  Parts: row, at (the first word), words, times.
    """
    targets = stage(source_targets(rows), "targets")
    joined = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    placed = stream_places(joined.where("size > 0").select("row", "doc_id", "size", "k", "n_docs"))
    end = F.col("begin") + F.col("size")
    spread = placed.select("*", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((end - 1) / block))).alias("block"))
    start, stop = F.greatest("begin", F.col("block") * block), F.least(end, (F.col("block") + 1) * block)
    parts = spread.select("row", "k", "block", (start - F.col("begin")).alias("at"), (stop - start).alias("words"))
    drawn = drawn_blocks(targets, block, **options)
    # both sides grow with the input: neither is to be sent whole
    return joined.select("row", "doc_id", "size", "source_size", "target"), parts.join(drawn.hint("merge"), ["k", "block"]).select("row", "at", "words", "times")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """``docs`` with a row number and its size in words, stored once so that both stay as they are."""
    size = F.size(words(whole("text"))).cast("long").alias("size")
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size, *more), "sized")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and ``taken`` words for each row of ``docs`` (doc_id, source, text).

    A null text has size 0; a null source is a source, the last one; repeated rows are documents of their
    own; ties in doc_id are ordered by size, null ids come first; an empty table gives an empty result;
    other columns are ignored.  A source without words has target 0.
    """
    placed, parts = taken_ranges(sized(docs))
    taken = parts.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each document of which words are taken.

    A document taken whole once keeps its text.  Otherwise its text is the words of the first pass, joined
    by blanks, then, after a blank line, those taken a second time.  Column ``length``, where present,
    is the new text's length.  Documents without a taken word are left out, so also null and empty texts.
    Nulls, repeated rows, ties and an empty table as in :func:`mix`; columns may have any names.
    """
    first = ("doc_id", "source", "text")
    place = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in first}
    carried = F.struct(*[F.col(quoted(c)).alias(p) for c, p in place.items()], F.lit(0).alias("none")).alias("_own")
    rows = sized(docs.select(*first, carried), "text", "_own")
    _, parts = taken_ranges(rows.select("row", "doc_id", "source", "size"))
    ranges = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "words", "times"))).alias("ranges"))
    # Neighbouring blocks taken equally often are not merged: a part is a slice of the words.
    got = rows.join(ranges, "row").withColumn("_words", words(whole("text")))

    def passed(n: int) -> Column:
        chosen = F.filter("ranges", lambda r: r["times"] >= n)
        parts_of = F.transform(chosen, lambda r: F.array_join(F.slice(F.col("_words"), (r["at"] + 1).cast("int"), r["words"].cast("int")), " "))
        return F.array_join(parts_of, " ")

    once = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["words"]) == F.col("size")
    twice = F.exists("ranges", lambda r: r["times"] > 1)
    new = F.when(once, F.col("text")).otherwise(passed(1))
    text = F.when(twice, F.concat(new, F.lit("\n\n"), passed(2))).otherwise(new)
    out = got.withColumn("text", text)
    sized_anew = lambda c: F.length("text").cast(docs.schema[c].dataType)
    return out.select(*[(sized_anew(c) if c == length else F.col("_own").getField(place[c]) if c in place else F.col(c)).alias(c) for c in docs.columns])
