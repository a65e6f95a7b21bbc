"""The model against a plain one on counters, both scoring joins, and the verdicts."""

import math
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import documents, empty, frame, prose
from quillpanel.llm import kneser_ney as kn

TEXTS = ["the cat sat on the mat", "a cat and a 42 hat", "", "the the the", "über den  Fluss\tund"]


def normal(text):
    out = bytearray()
    for b in text.encode():
        b = 0x30 if 0x30 <= b < 0x3A else 0x20 if b in (9, 10, 11, 12, 13) else b
        if b == 0x20 and (not out or out[-1] == 0x20):
            continue
        out.append(b)
    return bytes(out)


def grams(text, order):
    t = b" " * (order - 1) + normal(text)
    return [t[i : i + order] for i in range(len(t) - order + 1)]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        counts = {order: Counter(g for t in texts for g in grams(t, order))}
        for k in range(order - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.counts = counts
        self.d = {k: kn.discounts(*[sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]) for k, c in counts.items()}
        self.context = {k: defaultdict(list) for k in counts}
        for k, c in counts.items():
            for g, n in c.items():
                self.context[k][g[:-1]].append(n)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / 257
        below = self.p(gram[1:])
        seen = self.context[k].get(gram[:-1])
        if not seen:
            return below
        cut = lambda n: self.d[k][min(n, 3) - 1]
        n = self.counts[k].get(gram, 0)
        return ((n - cut(n) if n else 0) + sum(map(cut, seen)) * below) / sum(seen)


@pytest.fixture(scope="module")
def model(spark):
    return kn.fit(spark.createDataFrame([(t,) for t in TEXTS], "text string"), 3)


def test_scores_are_those_of_the_plain_model(spark, model):
    plain = Plain(TEXTS, 3)
    asked = frame(spark)
    texts = {r[0]: r[1] for r in documents()}
    expected = {d: sum(math.log10(plain.p(g)) for g in grams(t or "", 3)) for d, t in texts.items() if d is not None}
    for found in (kn.perplexities(asked, model, 3), kn.joined_perplexities(asked.select("doc_id", "lang", "text"), model, 3)):
        rows = found.collect()
        assert len(rows) == len(documents())
        for r in rows:
            if r.doc_id is not None:
                assert r.log10_prob == pytest.approx(expected[r.doc_id], rel=1e-4, abs=1e-4)
                assert r.n_tokens == len(normal(texts[r.doc_id] or ""))


def test_probabilities_sum_to_one(model):
    rows = {(r.k, r.gram): r for r in model.collect()}
    plain = Plain(TEXTS, 3)
    for context in (b"th", b"at", b"zz"):
        assert sum(plain.p(context + bytes([b])) for b in range(256)) + 1 / 257 >= 0.999
    assert rows[(0, 0)].log10_p == pytest.approx(math.log10(1 / 257))


def test_verdicts(spark):
    clean = [(i, prose(i, 60), "en", "a", 0, 7, "x", 1, "own", 2, "y") for i in range(80)]
    junk = [(100 + i, "".join(chr(33 + (i * 7 + k * k) % 90) for k in range(200)), "en", "a", 0, 7, "x", 1, "own", 2, "y") for i in range(5)]
    odd = [(200, None, "en", "a", 0, 7, "x", 1, "own", 2, "y"), (201, "", None, None, 0, 7, "x", 1, "own", 2, "y"), (202, prose(500, 60), "xx", None, 0, 7, "x", 1, "own", 2, "y"), clean[0]]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, clean + junk + odd)
    got = {r.doc_id: r.kept for r in kn.classify(df, labels).collect()}
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk)
    assert not got[200] and not got[201] and got[202]
    kept = kn.accepted(df, labels)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted([r[0] for r in clean] + [202, 0])
    assert kn.classify(empty(spark), labels).count() == 0
    without = {r.doc_id: r.kept for r in kn.classify(df, labels.limit(0)).collect()}
    assert without[100] and not without[200]


def test_limit_is_the_quantile_and_its_error(spark):
    """One rule at every number of rows; the error falls with its root."""
    rows = [(i, "many", 1000, -1000.0 - i) for i in range(1000)] + [(2000 + i, "few", 1000, -1000.0 - i) for i in range(199)]
    rows += [(3000, "one", 1000, -1100.0)]
    scores = spark.createDataFrame(rows, "doc_id long, lang string, n_tokens long, log10_prob double")
    good = scores.select(F.col("doc_id").alias("_good"))
    got = {r.lang: r.threshold for r in kn.limited(scores, good, 0, kn.QUANTILE, kn.ERRORS).collect()}

    def error(n):
        z = NormalDist().inv_cdf(0.995)
        return kn.ERRORS * np.std(np.arange(n)) / 1000 * math.sqrt(0.995 * 0.005 / n) / NormalDist().pdf(z)

    assert got == {"many": pytest.approx(10 ** (1.994 + error(1000))), "few": pytest.approx(10 ** (1.198 + error(199))), "one": pytest.approx(10**1.1)}


def test_both_scoring_joins_agree_bit_for_bit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = kn.fit(docs.where("doc_id % 2 = 0 and text is not null").select("text"))
    by_copy = {r.doc_id: (r.n_tokens, r.log10_prob) for r in kn.perplexities(docs, model).collect()}
    by_join = {r.doc_id: (r.n_tokens, r.log10_prob) for r in kn.joined_perplexities(docs.select("doc_id", "lang", "text"), model).collect()}
    assert by_copy == by_join and len(by_copy) == docs.count()


def test_recall_by_kind_of_junk(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    kept = {r.doc_id: r.kept for r in kn.classify(docs, labels).collect()}
    total, rejected = Counter(), Counter()
    for r in docs.join(labels, "doc_id").where("text <> ''").select("doc_id", "text", "quality").collect():
        words = r.text.split()
        if r.quality:
            kind = "good"
        elif len(words) >= 10 and len(set(words)) < 0.2 * len(words):
            kind = "repeats"
        elif sum(c.isalpha() or c.isspace() for c in r.text) < 0.7 * len(r.text):
            kind = "signs"
        else:
            kind = "other"
        total[kind] += 1
        rejected[kind] += not kept[r.doc_id]
    share = {k: rejected[k] / n for k, n in total.items()}
    assert share["good"] < 0.01 and share["signs"] > 0.95 and share["other"] > 0.95 and share["repeats"] > 0.7


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    table = kn.Lookup(keys[::2], np.arange(len(keys[::2]), dtype=np.float32))
    found, value = table(keys)
    assert found[::2].all() and not found[1::2].any() and (value[::2] == np.arange(len(keys[::2]))).all()


def test_every_trusted_document_trains_or_judges(spark):
    """The training half grows with the rows; there is no bound of documents per language."""
    trusted = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    counts = {r.trains: r["count"] for r in kn.sampled(trusted).groupBy("trains").count().collect()}
    assert sum(counts.values()) == 20000 and abs(counts[True] - 10000) < 400
