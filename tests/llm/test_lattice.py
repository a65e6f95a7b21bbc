"""Base figures against plain counts, and the lattice against all segmentations."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fixtures import documents, empty, frame
from quillpanel.llm import lattice as L
from quillpanel.llm.queries import VOCABULARY, tokenizer_path

PIECES = sorted({bytes([b]) for b in range(256)} | {b" t", b" th", b"he", b"the", b" the", b"er", b"r" * 3})


def paths(word):
    if not word:
        yield ()
    for n in range(1, L.LONGEST_PIECE + 1):
        if len(word) >= n and word[:n] in PIECES:
            for rest in paths(word[n:]):
                yield (word[:n], *rest)


def test_sums_over_all_segmentations():
    rng = np.random.default_rng(0)
    w = rng.random(len(PIECES)) + 0.01
    log_p = np.log(w / w.sum())
    at = {p: i for i, p in enumerate(PIECES)}
    words = [b"there", b"the", b"t", b"rrrrrr", b"", "é".encode()]
    found = L.word_scores(words, L.Lattice(PIECES), log_p)
    uses = L.word_uses(words, np.arange(1.0, 7.0), L.Lattice(PIECES), log_p)
    expected, plain = np.zeros(len(PIECES)), []
    for k, word in enumerate(words):
        weights = [(p, math.exp(sum(log_p[at[x]] for x in p))) for p in paths(b" " + word)]
        total = sum(v for _, v in weights)
        plain.append(math.log(total))
        for p, v in weights:
            for x in p:
                expected[at[x]] += (k + 1) * v / total
    assert np.allclose(found, plain) and np.allclose(uses, expected)


def test_long_words_give_the_same():
    lattice, log_p = L.Lattice(PIECES), np.log(np.full(len(PIECES), 1 / len(PIECES)))
    word = b"there" * 12
    short = L.word_scores([word], lattice, log_p)[0]
    edges = lattice.long_edges(b" " + word)
    assert lattice.long_sums(b" " + word, edges, log_p)[-1] == pytest.approx(short)
    assert lattice.long_sums(b" " + word, edges, log_p, True)[0] == pytest.approx(short)
    assert L.word_scores([word * 3], lattice, log_p)[0] < short


@pytest.mark.parametrize("head", [0, 10, L.HEAD])
def test_base_figures(spark, head):
    rows = documents()
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows}
    words = lambda t: (t or "").encode().lower().split()
    c, ends = Counter(), 0
    for r in rows:
        if not held[r[0]]:
            c.update(words(r[1]))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
    got = L.score(frame(spark), tokenizer_path(VOCABULARY), iterations=1, head=head).collect()
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        assert r.train_tokens == n and math.isfinite(r.score) and r.score < 0
        if r.doc_id is not None:
            w = words(text[r.doc_id])
            assert (r.n_tokens, r.n_known, r.held_out) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, held[r.doc_id])
            assert r.base_score == pytest.approx(base(text[r.doc_id]))


def test_training_helps_and_empty_tables(spark):
    path = tokenizer_path(VOCABULARY)
    total = lambda k: sum(r.score for r in L.score(frame(spark), path, iterations=k).collect() if not r.held_out)
    assert total(3) > total(0)
    assert L.score(empty(spark), path, iterations=1).count() == 0


def test_pieces_of_any_length_count():
    pieces, scores = L.vocabulary(tokenizer_path(VOCABULARY))
    long_ = " населения".encode()
    assert long_ in pieces and len(pieces) == len(scores) and max(map(len, pieces)) > 16
    log_p = np.full(len(pieces), -20.0)
    log_p[pieces.index(long_)] = -1.0
    lattice = L.Lattice(pieces)
    assert L.word_scores([long_[1:]], lattice, log_p)[0] == pytest.approx(-1.0, abs=1e-3)
    assert any(k == pieces.index(long_) for _, _, k in lattice.long_edges(long_ * 5))


def test_three_rounds_unless_told(spark):
    path = tokenizer_path(VOCABULARY)
    scores = lambda **k: {r.doc_id: r.score for r in L.score(frame(spark), path, **k).collect() if r.doc_id is not None}
    assert scores() == pytest.approx(scores(iterations=3))
    assert scores() != pytest.approx(scores(iterations=2))
