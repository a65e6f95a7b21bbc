"""Held-out accuracy, unknown texts and the subword hashes."""

import random

import numpy as np

from fixtures import documents, empty, frame
from quillpanel.llm import language

WORDS = {"en": ["the", "and", "house", "with", "water"], "de": ["der", "und", "haus", "mit", "wasser"], "fr": ["le", "et", "maison", "avec", "eau"]}


def labelled():
    r = random.Random(3)
    rows = []
    for i in range(150):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 60))), lang, "a", 0, 7, "x", 1, "own", 2, "y"))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled()
    rows += [(500, None, "en", "a", 0, 7, "x", 1, "own", 2, "y"), (501, "12 34 !!", "de", "a", 0, 7, "x", 1, "own", 2, "y"), (502, "", None, None, 0, 7, "x", 1, "own", 2, "y"), rows[0]]
    got = language.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    import zlib

    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id >= 500:
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
    tested = [r for r in got if r.held_out and r.doc_id < 500]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.95


def test_odd_tables(spark):
    assert language.identify(empty(spark)).count() == 0
    assert language.identify(frame(spark)).count() == len(documents())
    unlabelled = [(1, "some text", None, None, 0, 7, "x", 1, "own", 2, "y")]
    assert language.identify(frame(spark, unlabelled)).first().lang_pred == "und"


def test_subwords_do_not_depend_on_blocks_or_neighbours():
    classes = language.byte_classes()
    texts = [b"Alpha beta", b"", b"gamma-delta epsilon" * 20]
    count = lambda ts, block: [np.bincount(np.concatenate([k[o == i] for o, k in language.subwords(ts, classes, block)]), minlength=1 << language.BITS) for i in range(len(ts))]
    whole = count(texts, 1 << 20)
    for i, t in enumerate(texts):
        assert (count([t], 7)[0] == whole[i]).all()
