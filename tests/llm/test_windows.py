"""Text is taken apart in windows of bounded size, with the same result as at once; odd column names stay."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fixtures import documents, frame, prose
from quillpanel.llm import batches, kneser_ney, minhash, mixing, secrets, words
from quillpanel.llm.encoding import WordEncoder

TEXTS = [b"", b" ", b"a", b"\n\n b  c\t", prose(3, 200).encode(), b"z" * 300, b" " * 90 + b"x" * 40 + b" ", "é ñ".encode() * 30, b"one two"]


def test_word_hashes(monkeypatch):
    spaces = words.space_table()
    whole, bounds = words.word_hashes(TEXTS, spaces)
    assert np.diff(bounds).tolist() == [len(t.split()) for t in TEXTS]
    every = [w for t in TEXTS for w in t.split()]
    assert len(set(zip(every, whole.tolist(), strict=True))) == len(set(every)) == len(set(whole.tolist()))
    for window in (1, 2, 7, 64):
        monkeypatch.setattr(words, "WINDOW", window)
        parts, again = words.word_hashes(TEXTS, spaces)
        assert parts.tolist() == whole.tolist() and again.tolist() == bounds.tolist()
    assert words.word_hashes([], spaces)[1].tolist() == [0]


@pytest.mark.parametrize("order", [2, 5])
def test_packed(order):
    table = kneser_ney.plain_bytes()

    def pairs(window):
        return [p for o, k in kneser_ney.packed(TEXTS, table, order, window) for p in zip(o.tolist(), k.tolist(), strict=True)]

    whole = pairs(1 << 20)
    for i, t in enumerate(TEXTS):  # one byte after the other
        now, want = b" " * order, []
        for b in table[np.frombuffer(t, np.uint8)].tobytes():
            if b != 0x20 or now[-1] != 0x20:
                now = now[1:] + bytes([b])
                want.append((i, int.from_bytes(now, "big")))
        assert [p for p in whole if p[0] == i] == want
    for window in (1, 3, 50):
        assert pairs(window) == whole


def test_one_long_text_stays_in_bounds():
    """20 MB of text need its words' hashes and a window; a worker's peak is measured by the system."""
    import resource

    r = random.Random(1)
    text = (" ".join(prose(i, 60) for i in range(400)) * 160).encode()[: 20 << 20]
    table, spaces = kneser_ney.plain_bytes(), words.space_table()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(len(key) for _, key in kneser_ney.packed([text], table))
    assert n <= len(text) and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60 << 10
    assert len(words.shingle_sets([text], spaces)[0]) > r.randint(1, 2)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10


def test_tables_of_other_operators_go():
    tables = batches.worker_tables()
    tables["encoder", "x"], tables["other", "y"] = 1, 2
    assert list(batches.slices([], keep="encoder")) == [] and "x" in {k[1] for k in tables if isinstance(k, tuple)}
    assert ("other", "y") not in tables
    assert list(batches.slices([])) == [] and ("encoder", "x") not in tables


def test_encoder_keeps_short_words_only():
    import public_tokenizers

    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = ("ab " + "x" * 500 + " " + "1" * 100 + "!").encode()
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert all(len(k) <= 64 for kept in (encoder.words, encoder.units) for k in kept)


ODD = ["my col", "_", "_rows", "_kept_id", "_place", "_own_spans", "spans", "own", "a`b", "my.col", "_own"]


def odd(spark, rows):
    df = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for i, name in enumerate(ODD):
        df = df.withColumn(name, F.lit(i))
    return df.withColumn("nested", F.struct(F.lit(1).alias("a-b"), F.lit("x").alias("c d")))


@pytest.mark.parametrize("rows", [documents(), []], ids=["rows", "empty"])
def test_any_column_names(spark, rows):
    """Every stage of the pipeline that returns documents keeps columns of any name."""
    df = odd(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    for apply in (lambda d: kneser_ney.accepted(d, labels), minhash.without_copies, secrets.redact_secrets, mixing.mixed_documents):
        out = apply(df)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        for r in out.collect():
            assert [r[c] for c in ODD] == list(range(len(ODD))) and r["nested"]["a-b"] == 1
    assert {name for name, _ in corpus_pipeline.STAGES} == {"quality", "near_copies", "secrets", "mixing", "packing"}


def test_batches_get_smaller_only(spark):
    assert [batches.amount(x) for x in ("-1", "7", "9b", "8kb", "64m", "2G", "1MiB")] == [-1, 7, 9, 8 << 10, 64 << 20, 2 << 30, 1 << 20]
    docs, rows = frame(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:
        for own, then in (("10000", "1000"), ("0", "1000"), ("3", "3")):
            spark.conf.set(rows, own)
            assert batches.in_batches(docs) is docs and spark.conf.get(rows) == then
        found = secrets.find_secrets(docs).count()  # three rows a batch
        assert found == docs.count()
    finally:
        spark.conf.set(rows, before)
