"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

The model is trained on trusted text: documents labelled good.  Every one of them is used: a hash of doc_id
deals them into two halves, one is counted whole, the other sets the limits.  Counts, continuation counts, discounts
and context masses are grouped and joined by n-gram, so every table is dealt over the shuffle's shards
by the n-gram's own bytes; no table is gathered while fitting.  The fitted table has one row per n-gram
seen, with its interpolated probability and the weight its context hands to shorter ones.

A document's perplexity takes a lookup per byte.  While the table has at most MOST_ROWS rows, each task
joins its documents with a copy (``perplexities``).  A larger table is joined by shuffles over n-grams counted per document (``joined_perplexities``).  Both
add the same whole numbers, logarithms in units of 1 / UNITS, so they and any repeated task agree to the
last bit.  Documents whose perplexity exceeds the quantile of their language's trusted documents that did
not train the model, by more than that quantile's own uncertainty, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillpanel.llm.batches import column, in_batches, quoted, slices, utf8
from quillpanel.llm.words import U, mixed
from quillpanel.session import stage

ORDER = 5
#: Bound of the training half, in documents per language; None: the whole half.
SAMPLE_TEXTS = None
#: A document is rejected above this quantile of trusted ones of its language.
QUANTILE = 0.995
#: Standard errors of the quantile that a limit lies above it: its upper confidence limit at 97.5 per cent.
ERRORS = 1.96
#: Parts of 1 that logarithms are rounded to.
UNITS = 1 << 20
#: Largest model that tasks hold a copy of: 12 bytes a row, at most half full.
MOST_ROWS = 4_000_000
#: Most training documents whose ids are sent to every executor.
MOST_SAMPLED = 200_000
BINS_PER_DECADE = 1000
#: Bytes of text that are taken apart at once.
WINDOW = 1 << 18
SEED = 5

GRAMS = "k int, gram long, n long"
DOCUMENT = "doc_id long, lang string, n_tokens long, log10_prob double"


def plain_bytes() -> np.ndarray:
    """Digits as one sign, white space as blanks; everything else as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[0x30:0x3A] = 0x30
    t[[9, 10, 11, 12, 13]] = 0x20
    return t


def _packed(parts: list[tuple[int, bytes, bytes]], table: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``parts`` (number, the ``order - 1`` bytes before, bytes): each byte's number and gram."""
    buffer = table[np.frombuffer(b"".join(lead + t for _, lead, t in parts), np.uint8)]
    sizes = np.array([len(t) + order - 1 for _, _, t in parts])
    owner = np.repeat(np.array([i for i, _, _ in parts], np.int32), sizes)
    own = np.ones(len(buffer), bool)
    for k in range(order - 1):
        own[np.cumsum(sizes) - sizes + k] = False
    blank = buffer == 0x20
    keep = ~own | ~blank | ~np.concatenate([[False], blank[:-1]])
    buffer, owner, own = buffer[keep], owner[keep], own[keep]
    wide = buffer.astype(U)
    key = wide.copy()
    for k in range(1, order):
        key[k:] |= wide[:-k] << U(8 * k)
    return owner[own], key[own]


def packed(texts: list[bytes], table: np.ndarray, order: int = ORDER, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every byte of all texts: the text's number, and it with its ``order - 1`` predecessors in one number.

    Runs of blanks count as one; before the first byte stand blanks.  Each pair of arrays is about
    ``window`` bytes of text: several texts, or a part of a long one that goes on from the part before.
    """
    start = b" " * (order - 1)
    parts, size = [], 0
    for i, text in enumerate(texts):
        if parts and size + len(text) > window:
            yield _packed(parts, table, order)
            parts, size = [], 0
        if len(text) <= window:
            parts.append((i, start, text))
            size += len(text) + order - 1
            continue
        lead = start
        for at in range(0, len(text), window):
            owner, key = _packed([(i, lead, text[at : at + window])], table, order)
            if len(key):
                lead = int(key[-1]).to_bytes(8, "big")[9 - order :]
            yield owner, key
    if parts:
        yield _packed(parts, table, order)


def _counted(order: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plain_bytes()
        for batch in slices(batches):
            for _, key in packed(utf8(column(batch, "text")), table, order):
                gram, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return run


def _place() -> Column:
    """A hash of doc_id, from 0 up to 1; trusted rows below 0.5 may train."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(SEED)), F.lit(1 << 20)) / (1 << 20)


def sampled(trusted: DataFrame, texts: int | None = SAMPLE_TEXTS) -> DataFrame:
    """``trusted`` (doc_id, lang, text) with ``trains``: whether a row trains the model; the others set the thresholds.

    Rows are dealt by a hash of doc_id: half of them train, or about ``texts`` per language if that is fewer.
    """
    if texts is None:
        return trusted.withColumn("trains", _place() < 0.5)
    sizes = trusted.groupBy("lang").agg(F.least(F.lit(0.5), texts / F.count(F.lit(1))).alias("_part"))
    sizes = sizes.withColumnRenamed("lang", "_lang")
    joined = trusted.join(sizes, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("trains", _place() < F.col("_part"))
    return joined.drop("_lang", "_part")


def fit(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of ``texts`` (text): k, gram, log10_p, log10_gamma; gram holds the last k bytes.

    log10_p is null for grams that are contexts only, log10_gamma (the weight handed on by a context of k
    bytes) for grams that are no context.  Row k = 0 holds the share of a byte never seen in ``log10_p``.
    """
    raw = in_batches(texts).select("text").mapInArrow(_counted(order), "gram long, n long")
    counts = {order: stage(raw.groupBy("gram").agg(F.sum("n").alias("n")), "grams")}
    for k in range(order - 1, 0, -1):
        # Continuation counts: of how many different bytes the gram is a continuation.
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        counts[k] = stage(counts[k + 1].select(suffix).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    kinds = counts[1].count()  # at most 256
    lower, parts = None, []
    uniform = 1.0 / 257
    for k in range(1, order + 1):
        of = counts[k].agg(*[F.sum((F.col("n") == c).cast("long")).alias(f"n{c}") for c in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts(*[of[f"n{c}"] or 0 for c in (1, 2, 3, 4)])
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts[k].select("gram", "n", F.shiftrightunsigned("gram", 8).alias("context"), taken.alias("d"))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        rows = rows.join(contexts, "context")
        own, gamma = (F.col("n") - F.col("d")) / F.col("total"), F.col("left") / F.col("total")
        if k == 1:
            lower = rows.select("gram", (own + gamma * uniform).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            shorter = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            lower = rows.withColumn("suffix", suffix).join(shorter, "suffix").select("gram", (own + gamma * F.col("q")).alias("p"))
        lower = stage(lower, "probabilities")
        parts.append(lower.select(F.lit(k).alias("k"), "gram", F.log10("p").alias("log10_p"), F.lit(None).cast("double").alias("log10_gamma")))
        weights = contexts.select(
            F.lit(k - 1).alias("k"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("log10_p"), F.log10(F.col("left") / F.col("total")).alias("log10_gamma")
        )
        parts.append(weights)
    model = parts[0]
    for p in parts[1:]:
        model = model.union(p)
    model = model.groupBy("k", "gram").agg(F.max("log10_p").alias("log10_p"), F.max("log10_gamma").alias("log10_gamma"))
    unseen = F.when(F.col("k") == 0, F.lit(float(np.log10(uniform)))).otherwise(F.col("log10_p"))
    if not kinds:  # no text: every byte is as likely
        spark = texts.sparkSession
        return spark.range(1).select(
            F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"), F.lit(float(np.log10(uniform))).alias("log10_p"), F.lit(0.0).alias("log10_gamma")
        )
    return stage(model.withColumn("log10_p", unseen), "model")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of grams so often seen."""
    if not n1:
        return 0.1, 0.1, 0.1
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), c - 0.05) for d, c in zip(found, (1, 2, 3), strict=True))


class Lookup:
    """A table from 64-bit keys to numbers, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, U(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << bits, values.dtype)
        left = np.arange(len(keys))
        place = self._place(keys)
        while len(left):
            free = self.keys[place[left]] == U(0xFFFFFFFFFFFFFFFF)
            first = np.unique(place[left[free]], return_index=True)[1]
            chosen = left[free][first]
            self.keys[place[chosen]], self.values[place[chosen]] = keys[chosen], values[chosen]
            left = left[self.keys[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 where it isn't)."""
        place = self._place(keys)
        there = self.keys[place]
        found, out = there == keys, np.where(there == keys, self.values[place], self.values.dtype.type(0))
        open_ = np.flatnonzero(~found & (there != U(0xFFFFFFFFFFFFFFFF)))
        at = place[open_]
        while len(open_):
            at = (at + 1) & self.mask
            there = self.keys[at]
            hit = there == keys[open_]
            found[open_[hit]], out[open_[hit]] = True, self.values[at[hit]]
            more = ~hit & (there != U(0xFFFFFFFFFFFFFFFF))
            open_, at = open_[more], at[more]
        return found, out


def _tagged(gram: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Gram and its length as one key; grams have at most 7 bytes."""
    return gram | (np.asarray(k).astype(U) << U(56))


def _scorer(shared, order: int, carry: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (p_key, p_value), (gamma_key, gamma_value), unseen = shared.value
        probability, weight = Lookup(p_key, p_value), Lookup(gamma_key, gamma_value)
        table = plain_bytes()

        def scored(key: np.ndarray) -> np.ndarray:
            out, left = np.zeros(len(key), np.int64), np.arange(len(key))
            for length in range(order, 0, -1):
                own = key[left] & U((1 << 8 * length) - 1)
                found, p = probability(_tagged(own, length))
                out[left[found]] += p[found]
                left, own = left[~found], own[~found]
                if len(left):
                    out[left] += weight(_tagged(own >> U(8), length - 1))[1]
            out[left] += unseen
            return out

        for batch in slices(batches):
            texts = utf8(column(batch, "text"))
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for owner, key in packed(texts, table, order):
                n += np.bincount(owner, minlength=len(texts))
                np.add.at(total, owner, scored(key))
            kept = [c for c in batch.schema.names if carry or c != "text"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(total / UNITS)], [*kept, "n_tokens", "log10_prob"])

    return run


def in_units(model: DataFrame) -> DataFrame:
    """k, gram, p and gamma: the model's logarithms in whole units."""
    whole = lambda c: F.round(F.col(c) * UNITS).cast("long")
    return model.select("k", "gram", whole("log10_p").alias("p"), whole("log10_gamma").alias("gamma"))


def perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER, carry: bool = False) -> DataFrame:
    """doc_id, lang, n_tokens (bytes, blanks run together) and log10_prob of each row of ``docs``.

    With ``carry`` all columns of ``docs`` stay before the two, which it must not have itself.
    """
    if not carry:
        docs = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    if model.count() > MOST_ROWS:
        return joined_perplexities(docs, model, order, carry)
    rows = in_units(model).toPandas()  # its size has just been checked
    key = _tagged(rows.gram.to_numpy(np.int64).view(U), rows.k.to_numpy(np.int64))
    pairs = [(key[there], values[there].to_numpy(np.int32)) for values in (rows.p, rows.gamma) for there in [values.notna().to_numpy()]]
    shared = docs.sparkSession.sparkContext.broadcast((*pairs, int(rows.p[rows.k == 0].max())))
    kept = StructType([f for f in docs.schema if carry or f.name != "text"])
    return in_batches(docs).mapInArrow(_scorer(shared, order, carry), kept.add("n_tokens", "long").add("log10_prob", "double"))


def _document_grams(order: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plain_bytes()
        for batch in slices(batches):
            rows = np.array(column(batch, "row"), np.int64)
            for owner, key in packed(utf8(column(batch, "text")), table, order):
                # equal grams of a text next to each other, texts in order
                by = np.lexsort((key, owner))
                owner, key = owner[by], key[by]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])[: len(key)])
                n = np.diff(np.append(first, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[owner[first]]), pa.array(key[first].view(np.int64)), pa.array(n)], ["row", "gram", "n"])

    return run


def joined_perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER, carry: bool = False) -> DataFrame:
    """As ``perplexities``, with the model left where it is: n-grams per document are joined with it, longest first."""
    own = docs.columns if carry else ["doc_id", "lang", "text"]
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(quoted(c)) for c in own]).alias("own")), "rows")
    left = rows.select("row", F.col("own.text").alias("text")).mapInArrow(_document_grams(order), "row long, gram long, n long")
    units = in_units(model)
    done = []
    for k in range(order, 0, -1):
        p = units.where(F.col("k") == k).select("gram", "p").where("p is not null")
        tried = stage(left.join(p, "gram", "left"), "tried")
        done.append(tried.where("p is not null").select("row", (F.col("n") * F.col("p")).alias("s"), "n"))
        gamma = units.where(F.col("k") == k - 1).select(F.col("gram").alias("context"), "gamma")
        missed = tried.where("p is null").withColumn("context", F.shiftrightunsigned("gram", 8)).join(gamma, "context", "left")
        done.append(missed.select("row", (F.col("n") * F.coalesce("gamma", F.lit(0))).alias("s"), F.lit(0).cast("long").alias("n")))
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("gram")
        left = missed.select("row", suffix, "n").groupBy("row", "gram").agg(F.sum("n").alias("n"))
    unseen = units.where("k = 0").agg(F.max("p")).first()[0]
    done.append(left.select("row", (F.col("n") * F.lit(unseen)).alias("s"), "n"))
    all_ = done[0]
    for d in done[1:]:
        all_ = all_.union(d)
    sums = all_.groupBy("row").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    kept = [F.col("own").getField(c).alias(c) for c in own if carry or c != "text"]
    return rows.join(sums, "row", "left").select(
        *kept, F.coalesce("n", F.lit(0)).alias("n_tokens"), (F.coalesce("s", F.lit(0)) / F.lit(float(UNITS))).alias("log10_prob")
    )


def thresholds(scores: DataFrame, quantile: float = QUANTILE, errors: float = ERRORS) -> DataFrame:
    """lang and the log10 of its limit of perplexity; all rows are counted.

    The limit is the value that the share ``quantile`` of a language's rows do not exceed, plus ``errors``
    standard errors of it.  A quantile q of n rows has the error sd * sqrt(q (1 - q) / n) / density, here with a
    normal curve's density at q: the rule is one at every n, and what few rows leave open goes as n grows.

    Perplexities are counted in bins of a thousandth of a decade, and a bin's upper end is taken, so that
    no language's rows meet in one task.  A row with lang null and ``every`` true stands for all languages.
    """
    binned = scores.where("n_tokens > 0").select("lang", F.ceil(_log10_perplexity() * BINS_PER_DECADE).alias("bin"))
    counted = binned.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    both = counted.select(F.lit(False).alias("every"), "lang", "bin", "n").union(
        counted.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(True), F.lit(None).cast("string"), "bin", "n")
    )
    group = W.partitionBy("every", "lang")  # over bins, not rows
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = lambda c: F.sum(c).over(group)
    sums = {"upto": upto, "of": total(F.col("n")), "s": total(F.col("n") * F.col("bin")), "q": total(F.col("n") * F.col("bin") * F.col("bin"))}
    reached = both.withColumns(sums).where(F.col("upto") >= quantile * F.col("of"))
    normal = NormalDist()
    share = (quantile * (1 - quantile)) ** 0.5 / normal.pdf(normal.inv_cdf(quantile))
    # n * sum of squares - square of the sum, in whole numbers
    sd = F.sqrt((F.max("of") * F.max("q") - F.max("s") * F.max("s")).cast("double")) / F.max("of")
    limit = (F.min("bin") + errors * share * sd / F.sqrt(F.max("of"))) / BINS_PER_DECADE
    return reached.groupBy("every", "lang").agg(limit.alias("log10_limit"))


def _log10_perplexity() -> Column:
    return -F.col("log10_prob") / F.col("n_tokens")


def trained(docs: DataFrame, good: DataFrame, texts: int | None = SAMPLE_TEXTS) -> DataFrame:
    """The model of the training half of ``docs`` (doc_id, lang, text) whose doc_ids are in ``good`` (_good)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").where("text is not null")
    trusted = docs.select("doc_id", "lang").join(good, F.col("doc_id") == F.col("_good"), "left_semi")
    chosen = stage(sampled(trusted, texts).where("trains").select(F.col("doc_id").alias("_good")).distinct(), "training")
    if chosen.count() <= MOST_SAMPLED:  # then the texts need not move to meet it
        chosen = F.broadcast(chosen)
    docs = docs.where(_place() < 0.5)  # no text of the other half moves
    return fit(docs.join(chosen, F.col("doc_id") == F.col("_good"), "left_semi").select("text"))


def limited(scores: DataFrame, good: DataFrame, texts: int | None, quantile: float, errors: float) -> DataFrame:
    """``scores`` with perplexity, threshold and kept, by the trusted rows that did not train the model."""
    plain = scores.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "n_tokens", "log10_prob")
    judged = sampled(plain.join(good, F.col("doc_id") == F.col("_good"), "left_semi"), texts).where("not trains")
    limits = stage(thresholds(judged, quantile, errors), "limits")
    own = limits.where("not every").select(F.col("lang").alias("_lang"), F.col("log10_limit").alias("_own"))
    if own.count() <= MOST_SAMPLED:  # one row per language
        own = F.broadcast(own)
    every = limits.where("every").agg(F.max("log10_limit")).first()[0]
    out = scores.join(own, F.col("lang").cast("string").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce("_own", F.lit(every).cast("double"))
    mine = F.when(F.col("n_tokens") > 0, _log10_perplexity())
    return out.withColumns(
        {
            "perplexity": F.pow(F.lit(10.0), mine),
            "threshold": F.pow(F.lit(10.0), limit),
            "kept": F.coalesce(mine <= F.coalesce(limit, F.lit(float("inf"))), F.lit(False)),
        }
    ).drop("_lang", "_own")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_good")).distinct()


def classify(docs: DataFrame, labels: DataFrame, texts: int | None = SAMPLE_TEXTS, quantile: float = QUANTILE, errors: float = ERRORS) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold, kept for each row of ``docs`` (doc_id, lang, text).

    ``labels`` (doc_id, quality) names the trusted documents by quality 1.  A text without a byte has no
    perplexity and is rejected.  A language, or null, without trusted documents that did not train takes
    the limit of all languages; without any trusted document nothing but empty texts is rejected.  Rows
    are judged each, ties at the limit are kept; an empty table gives an empty result; other columns are
    ignored.
    """
    good = trusted_ids(labels)
    scores = stage(perplexities(docs, trained(docs, good, texts)), "scores")
    return limited(scores, good, texts, quantile, errors).select("doc_id", "lang", "n_tokens", "log10_prob", "perplexity", "threshold", "kept")


def accepted(docs: DataFrame, labels: DataFrame, texts: int | None = SAMPLE_TEXTS, quantile: float = QUANTILE, errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns as they are, whatever their names."""
    good = trusted_ids(labels)
    first = ("doc_id", "lang", "text")
    place = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in first}
    carried = F.struct(*[F.col(quoted(c)).alias(p) for c, p in place.items()], F.lit(0).alias("none")).alias("own")
    scores = stage(perplexities(docs.select(*first, carried), trained(docs, good, texts), carry=True), "scores")
    kept = limited(scores, good, texts, quantile, errors).where("kept")
    return kept.select(*[F.col(c) if c in first else F.col("own").getField(place[c]).alias(c) for c in docs.columns])
