"""Language of whole texts: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its subwords, the byte 2-, 3- and 4-grams of its words with
their edges, hashed to a fixed number of rows.  Embeddings and softmax are trained by stochastic gradient
descent in numpy on a bounded sample of labelled texts, cut into short examples as well as whole ones.
A held part of the sample sets the temperature that makes the probabilities fit, and the probability
below which a prediction is rejected.  For prediction embeddings and softmax fold into one table with a
row per hash and a column per language, so a text costs one table row per subword, in any order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.batches import column, slices, utf8
from quillpanel.session import stage

BITS = 15
GRAMS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.1
BATCH = 64
SEED = 11
#: Bound of the training sample: texts over all languages, and short examples cut from each.
SAMPLE_TEXTS = 2400
#: Largest sample whose ids are sent to every executor.
MOST_SAMPLED = 200_000
CUTS, CUT_WORDS = 5, 12
#: Share of the sample that calibrates, and the share of wrong ones allowed among what is not rejected.
HELD = 0.2
ALLOWED_WRONG = 0.01
UNKNOWN = "und"
BLOCK = 1 << 20


def byte_classes() -> np.ndarray:
    """Lower case for A-Z, other letters and bytes over 7F as they are, everything else a blank."""
    t = np.full(256, 0x20, np.uint8)
    letters = np.arange(0x61, 0x7B)
    t[letters], t[letters - 32] = letters, letters
    t[0x80:] = np.arange(0x80, 0x100)
    return t


def subwords(texts: list[bytes], classes: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hash) of all subwords, in blocks of bytes; every text starts and ends with a blank."""
    buffer = np.frombuffer(b"".join(b" " + t + b" " for t in texts) + b" " * max(GRAMS), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
    total = int(starts[-1])
    for at in range(0, total, block):
        b = classes[buffer[at : min(at + block, total) + max(GRAMS) - 1]]
        n = len(b) - max(GRAMS) + 1
        blank = b == 0x20
        wide = b.astype(np.uint32)
        owner = np.searchsorted(starts, np.arange(at, at + n), "right") - 1 if len(texts) > 1 else np.zeros(n, np.int64)
        for g in GRAMS:
            ok = ~(blank[:n] & blank[1 : n + 1])
            key = wide[:n].copy()
            for k in range(1, g):
                key = (key << np.uint32(8)) | wide[k : n + k]
                if k < g - 1:
                    ok &= ~blank[k : n + k]
            if g > 2:
                ok &= ~blank[1 : n + 1]
            key = (key * np.uint32(2654435761)) ^ np.uint32(0x9E3779B1 * g & 0xFFFFFFFF)
            key = ((key ^ (key >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
            yield owner[ok], key[ok]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # a row per hash, a column per language
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, texts: list[bytes], classes: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for owner, key in subwords(texts, classes):
            if len(owner):
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums[owner[first]] += np.add.reduceat(self.table[key], first, axis=0, dtype=np.float64)
                count[owner[first]] += np.diff(np.r_[first, len(owner)])
        return softmax((sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(text: bytes, classes: np.ndarray) -> list[bytes]:
    """The whole text and short cuts spread evenly over it."""
    words = text.split()
    step = max(CUT_WORDS, len(words) // CUTS)
    cuts = [b" ".join(words[k : k + CUT_WORDS]) for k in range(0, len(words), step)][:CUTS]
    return [text, *cuts]


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash counts of the examples of labelled texts."""
    classes = byte_classes()
    for batch in slices(batches):
        rows: dict[str, list] = {"doc_id": [], "lang": [], "keys": [], "counts": []}
        for doc, lang, text in zip(column(batch, "doc_id"), column(batch, "lang"), utf8(column(batch, "text")), strict=True):
            for example in _examples(text, classes):
                keys, counts = np.unique(np.concatenate([k for _, k in subwords([example], classes)] or [[]]), return_counts=True)
                if len(keys):
                    rows["doc_id"].append(doc)
                    rows["lang"].append(lang)
                    rows["keys"].append(keys.astype(np.int32))
                    rows["counts"].append(counts.astype(np.int32))
        yield pa.RecordBatch.from_pydict(
            rows, pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("keys", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
        )


def train(examples: list[tuple[str, bool, np.ndarray, np.ndarray]]) -> Model:
    """Fit on (language, held, keys, counts); without examples the model knows no language."""
    languages = sorted({e[0] for e in examples})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(SEED)
    embedding = rng.uniform(-1, 1, (1 << BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weight, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    fit = [e for e in examples if not e[1]] or examples
    held = [e for e in examples if e[1]] or examples
    y = np.array([number[e[0]] for e in fit])
    shares = [(e[3] / e[3].sum()).astype(np.float32) for e in fit]
    # Step sizes fall with each parameter's squared gradients so far (AdaGrad): rare hashes learn as well.
    seen = [np.full_like(x, 1e-8) for x in (embedding, weight, bias)]

    def step(x: np.ndarray, squares: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        squares[rows] += gradient**2
        x[rows] -= RATE * gradient / np.sqrt(squares[rows])

    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for at in range(0, len(fit), BATCH):
            chosen = order[at : at + BATCH]
            keys = np.concatenate([fit[i][2] for i in chosen])
            share = np.concatenate([shares[i] for i in chosen])
            sizes = [len(fit[i][2]) for i in chosen]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(embedding[keys] * share[:, None], first, axis=0)
            error = softmax(mean @ weight + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error = (error / len(chosen)).astype(np.float32)
            back = error @ weight.T
            step(weight, seen[1], mean.T @ error)
            step(bias, seen[2], error.sum(0))
            unique, place = np.unique(keys, return_inverse=True)
            change = np.zeros((len(unique), DIMENSIONS), np.float32)
            push = np.repeat(back, sizes, axis=0) * share[:, None]
            for d in range(DIMENSIONS):
                change[:, d] = np.bincount(place, push[:, d], len(unique))
            step(embedding, seen[0], change, unique)
    table = embedding @ weight
    truth = np.array([number[e[0]] for e in held])
    logits = np.stack([(e[3][:, None] * table[e[2]]).sum(0) / e[3].sum() + bias for e in held])
    picks = np.arange(len(held))
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(softmax(logits / t)[picks, truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = softmax(logits / temperature)
    best = p.max(axis=1)
    by_score = np.argsort(-best, kind="stable")
    wrong = np.cumsum((p.argmax(axis=1) != truth)[by_score]) / np.arange(1, len(held) + 1)
    fine = np.flatnonzero(wrong <= ALLOWED_WRONG)
    reject_below = float(best[by_score[fine[-1]]]) if len(fine) else 1.0
    return Model(languages, table.astype(np.float32), bias.astype(np.float64), temperature, reject_below)


def hash_part(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def fit(labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> Model:
    """A model of the non-null values of ``lang`` from ``labelled`` (doc_id, lang, text).

    At most about ``texts`` texts are used: each language gives an equal share, chosen by a hash of doc_id.
    """
    labelled = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("long"), "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("part", F.least(F.lit(1.0), texts / F.count(F.lit(1)).over(_all()) / F.col("n")))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < F.col("part") * (1 << 20)
    chosen = labelled.select("doc_id", "lang").join(sizes.select("lang", "part"), "lang").where(drawn)
    chosen = stage(chosen.select(F.col("doc_id").alias("_chosen")).distinct(), "sample")
    if chosen.count() <= MOST_SAMPLED:  # then the texts need not move to meet it
        chosen = F.broadcast(chosen)
    sample = labelled.join(chosen, F.col("doc_id") == F.col("_chosen"), "left_semi")
    found = sample.mapInArrow(_features, "doc_id long, lang string, keys array<int>, counts array<int>").toArrow().to_pylist()
    # The order of rows is that of the tasks' results; sorted, the descent is the same each time.
    found.sort(key=lambda r: (r["lang"], r["doc_id"] or 0, len(r["keys"]), r["keys"][:4]))
    held = lambda doc: (doc or 0) * 2654435761 % 1000 < 1000 * HELD
    return train([(r["lang"], held(r["doc_id"]), np.array(r["keys"]), np.array(r["counts"])) for r in found])


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def _predictor(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        model, classes, letter = Model(*shared.value), byte_classes(), regex.compile(r"\p{L}").search
        for batch in slices(batches):
            texts = column(batch, "text")
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t and letter(t)]
            if known and model.languages:
                p = model.probabilities([texts[i].encode() for i in known], classes)
                for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                    langs[i], scores[i] = model.languages[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array([x != UNKNOWN and s >= model.reject_below for x, s in zip(langs, scores, strict=True)], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability) and accepted for each row of ``docs`` (doc_id, text).

    A null text or one without a letter is ``und`` with score 0, and so is every text if the model knows no
    language.  Rows are predicted each, also repeated ones; an empty table gives an empty result; columns
    other than doc_id and text are ignored.
    """
    # 2**15 rows of one number per language; plain values, which need no import on the executors
    plain = (model.languages, model.table, model.bias, model.temperature, model.reject_below)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    out = docs.select("doc_id", "text")
    kind = dict(out.dtypes)["doc_id"]
    return out.mapInArrow(_predictor(shared), f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, folds: int = 5, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """Learn from documents outside fold 0 of ``folds`` (crc32 of doc_id) and predict all."""
    model = fit(docs.where(hash_part(folds) != 0), texts)
    held = docs.select("doc_id", "text")
    return predict(held, model).select("doc_id", (F.coalesce(hash_part(folds), F.lit(-1)) == 0).alias("held_out"), "lang_pred", "score", "accepted")
