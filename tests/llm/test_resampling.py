"""Features, weights, scores and ranks against plain Python; the bisection on its own."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from fixtures import documents, empty, frame, prose
from quillpanel.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_features(text, longest):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % resampling.BUCKETS for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, longest=1, percent=10):
    features = [plain_features(r[1], longest) for r in rows]
    s = Counter(b for f in features for b in f)
    t = Counter(b for x in target for b in plain_features(x, longest))
    S, T, B = sum(s.values()), sum(t.values()), resampling.BUCKETS
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + B) / ((s[b] + 1) * (T + B))))
    out = []
    for r, f in zip(rows, features, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(r[1]))))
    able = sorted((o for o in out if o[4] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1]))
    drawn = Counter((*o[:4], k + 1) for k, o in enumerate(able[: len(able) * percent // 100]))
    rest = Counter(o[:4] for o in out) - Counter(d[:4] for d in drawn.elements())
    return drawn + Counter({(*k, None): n for k, n in rest.items()})


def got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_resample(spark, longest, percent):
    rows = documents() + [(1000 + i, prose(i % 40, 40), "en", "a", 0, 7, "x", 1, "own", 2, "y") for i in range(60)]
    texts = [prose(300 + i, 50) for i in range(5)] + [None, "", "Ω"]
    found = resampling.resample(frame(spark, rows), target(spark, texts), percent=percent, longest=longest)
    assert got(found) == plain(rows, texts, longest, percent)


def test_ties_beyond_the_cutoff(spark):
    """Rows of one id and text, and of no id, tie in score; as many as are wanted are drawn."""
    rows = [(d, prose(1, 30), "en", "a", 0, 7, "x", 1, "own", 2, "y") for d in [5] * 40 + [None] * 60 + [7] * 3]
    for percent in (20, 45, 90):
        found = resampling.resample(frame(spark, rows).repartition(7), target(spark, [prose(2, 30)]), percent=percent)
        assert got(found) == plain(rows, [prose(2, 30)], 1, percent)


def test_long_texts_are_read_in_windows(monkeypatch):
    text = (prose(4, 300) + "é" * 90 + " X\x00y " + "z" * 500 + " 1,2").encode()
    for longest in (1, 3):
        whole = [b for _, cells in resampling.Features(resampling.BUCKETS, longest).of(text) for b in cells]
        assert Counter(whole) == Counter(plain_features(text.decode(), longest))
        for window in (1, 7, 64, 1000):
            monkeypatch.setattr(resampling, "WINDOW", window)
            parts = list(resampling.Features(resampling.BUCKETS, longest).of(text))
            assert Counter(b for _, cells in parts for b in cells) == Counter(whole)
            assert sum(n for n, _ in parts) == len(words(text.decode()))
        monkeypatch.undo()


def test_bisection():
    values = sorted([-5, -5, 0, 3, 3, 3, 900, 10**12])
    for wanted in range(1, len(values) + 1):
        for levels in (1, 2, 5):
            calls = []
            counts = lambda xs: calls.append(xs) or [sum(v <= x for v in values) for x in xs]  # noqa: B023, E731
            assert resampling.bisected(values[0], values[-1], wanted, counts, levels) == values[wanted - 1]
            assert len(calls) <= 42 // levels + 2


def test_empty(spark):
    assert resampling.resample(empty(spark), target(spark, ["a"])).count() == 0
    assert resampling.resample(frame(spark), target(spark, [])).where("rank is not null").count() == 1
    assert resampling.drawn_documents(frame(spark), target(spark, ["the of an"])).columns == ["doc_id", "rank"]
