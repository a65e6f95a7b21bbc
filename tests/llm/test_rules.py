"""Figures against a plain count, and the posterior against a plain EM."""

from collections import Counter

from fixtures import documents, empty, frame, prose
from quillpanel.llm import rules


def plain(text):
    text = text or ""
    w = text.encode().split()
    triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    twice = {t for t, n in Counter(triples).items() if n > 1}
    covered = {k + j for k, t in enumerate(triples) if t in twice for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_figures(spark):
    more = ["a b c a b c a b", "x x x x x", "a b c d\n\na b c d\n \na b c d", "# | <> $% &* a", "a b\r\na b\n"]
    rows = documents() + [(200 + i, t, "en", "a", 0, 7, "x", 1, "own", 2, "y") for i, t in enumerate(more)]
    got = Counter(tuple(r) for r in rules.figures(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((r[0], *plain(r[1])) for r in rows)


def test_verdicts(spark):
    good = [(i, "\n".join(prose(i * 50 + k, 12) for k in range(8)), "en", "a", 0, 7, "x", 1, "own", 2, "y") for i in range(60)]
    junk = [(100 + i, " ".join(w + "###" for w in prose(i, 90).split()), "en", "a", 0, 7, "x", 1, "own", 2, "y") for i in range(6)]
    loud = [(200 + i, prose(i, 90).upper().replace(" ", "!! "), "en", "a", 0, 7, "x", 1, "own", 2, "y") for i in range(6)]
    odd = [(300, None, None, None, None, 7, "x", 1, "own", 2, "y"), (301, "", "en", "a", 0, 7, "x", 1, "own", 2, "y"), good[0]]
    got = {r.doc_id: r for r in rules.judge(frame(spark, good + junk + loud + odd)).collect()}
    assert all(got[i].kept for i in range(60))
    assert not any(got[r[0]].kept for r in junk + loud)
    assert got[300].base_failed and not got[300].kept and got[301].n_words == 0
    assert all(0 <= r.quality <= 1 for r in got.values())
    assert rules.judge(empty(spark)).count() == 0
