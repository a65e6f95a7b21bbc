"""Encoding, ORC output and packing against the tokenizers library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fixtures import documents, empty, frame
from quillpanel.llm import packing, token_orc
from quillpanel.llm.encoding import WordEncoder
from quillpanel.llm.queries import tokenizer_path
from quillpanel.session import new_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_words_give_the_ids_of_the_text(library):
    encoder = WordEncoder(tokenizer_path(), cache_words=3)
    for text in ["", "The cat's  hat!!", "ΑΣ Σ é é́ İ ſ ŉ", "a<|endoftext|>b <|startoftext|>", "x\x85y\x1cz\xa0", "1½² don't 'RE ﬁ µª", "日本\t🙂\x00"]:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == ids_of(library, text)[:-1].tolist()


def test_orc_round_trip(spark, library):
    rows = token_orc.tokenised(frame(spark), tokenizer_path()).collect()
    order = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    start = 0
    expected = Counter()
    for r in order:
        ids = ids_of(library, r[1])
        expected[(r[0], start, len(ids), zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in rows) == expected
    assert token_orc.tokenised(empty(spark), tokenizer_path()).count() == 0


def test_orc_single_documents(spark, library):
    path = new_path(spark, "tokens")
    token_orc.write_tokens(frame(spark), path, tokenizer_path())
    got = token_orc.read_tokens(spark, path, [5]).collect()
    assert len(got) == 1 and got[0].ids == ids_of(library, documents()[5][1]).tolist()
    plan = token_orc.read_tokens(spark, path, [5])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id,5)" in plan


def test_packing_holds_every_id_once(spark, library):
    got = packing.pack(frame(spark), tokenizer_path(), block_tokens=3000, keep_ids=True).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    by_start = defaultdict(list)
    for r in got:
        by_start[(r.doc_id, r.start)].append(tuple(r.ids))
    once = [d for d in documents() if d[0] not in (4, None)]
    for d in once:
        pieces = sorted(((s, i[0]) for (doc, s), i in by_start.items() if doc == d[0]), key=lambda x: x[0])
        assert [t for _, i in pieces for t in i] == ids_of(library, d[1]).tolist()
    assert sum(r.length for r in got) == sum(len(ids_of(library, d[1])) for d in documents())
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def test_layout_uses_combinations_and_wastes_nothing():
    rng = np.random.default_rng(1)
    rests = rng.integers(1, 2048, 3000)
    matrix = packing.combinations()
    assert (matrix.T @ np.arange(1, 33) == 32).all() and matrix.sum(axis=0).max() <= packing.DEPTH
    places, sequences = packing.layout(rests, matrix)
    filled = Counter()
    for p, begin, length, sequence, offset in places:
        filled[sequence] += length
    assert sum(n == 2048 for n in filled.values()) >= sequences - 11 and len(filled) == sequences
    assert len(places) < 1.6 * len(rests)


def test_nnls_against_enumeration():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = packing.nnls(a, np.array([4.0, 1.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [4, 1], atol=1e-8)
    assert np.allclose(packing.nnls(np.eye(2), np.array([3.0, -1.0])), [3, 0])
