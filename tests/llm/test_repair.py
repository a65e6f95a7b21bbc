"""Damage, faults, edits and digests against plain Python that tries all edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from quillpanel.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, row int, at string, kind string, edits int, cost int"
FINE = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", 1, 2) for r in rows], SCHEMA)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if mark == 1:
            text = ""
        if mark == 2:
            text = re.sub("[.!?]", "", text)
        if mark == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(mark, 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANK)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows, faults, insert=5):
    """The least (cost, audit, lines) by trying every edit of every row, memoised on place and state."""

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        needed = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[needed]
        if inserted < 3:
            cost, audit, lines = best(i, needed, inserted + 1)
            found.append((cost + insert, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            role, text = rows[i][2], rows[i][3]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, lines))
            if faults[i] in (None, "truncated"):
                more = 5 if faults[i] else 0
                if role[:1] == needed or (state == "" and role[:1] == "s"):
                    cost, audit, lines = best(i + 1, role[:1], 0)
                    found.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = best(i + 1, needed, 0)
                found.append((cost + more + 1, "R" + audit, (f"{name}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def order(row):
    return row[1] is not None, row[1] or 0, row[2].encode(), hashlib.sha256(row[3].encode()).hexdigest()


def plain_report(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        faults = plain_faults(own)
        cost, audit, lines = plain_repair(tuple(own), faults)
        turns = [r[1] for r in own if r[1] is not None]
        letters = [r[2][:1] for r in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def turns(n_conversations, longest, seed):
    r = random.Random(seed)
    rows = []
    for conv in range(n_conversations):
        for turn in range(r.randint(0, longest)):
            if r.random() < 0.9:
                role = r.choice(["user", "assistant", "system", "tool", "unknown", "", None]) if r.random() < 0.3 else ["user", "assistant"][turn % 2]
                text = r.choice(["Yes.", "no", " ", "", None, "Why?\n", "Ünd!", f"text {turn}."])
                rows.append((conv if conv % 9 else None, turn if r.random() < 0.95 else None, role, text))
    return rows + rows[:3]


def got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    out = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("piece", [1024, 3])
def test_report(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = turns(60, 14, piece)
    df = frame(spark, rows)
    want = plain_report(rows, plain_damage(rows))
    assert got(repair.report(repair.damaged(df), df)) == want
    assert any("R" in w[6] for w in want.values())


def test_cheap_inserts(monkeypatch):
    """Where inserting costs less than deleting, turns are inserted; blocks and ends included."""
    monkeypatch.setattr(repair, "INSERT", 1)
    monkeypatch.setattr(repair, "END", (0, 2, 1, 0))
    r, seen = random.Random(1), ""
    for n in range(200):
        rows = [(0, i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["no", "", f"{i}."])) for i in range(n % 12)]
        faults = plain_faults(rows)
        kinds = bytes("suat".index(row[2][0]) + 4 * (f is not None) + 4 * (f == "truncated") for row, f in zip(rows, faults, strict=True))
        found = list(repair.walked(kinds, repair.END, repair.STARTS, True))
        cost, audit, _ = plain_repair(tuple(rows), faults, 1)
        assert ("".join(w[1] for w in found), sum(w[2] for w in found)) == (audit, cost)
        seen += audit
    assert set(seen) == set("DIKR")


def test_one_long_conversation(spark, monkeypatch):
    """A conversation over many pieces and partitions has the edits that it has as one piece."""
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Yes.", "no"]) + f" {t}" + r.choice([".", ".", ""])) for t in range(700)]
    monkeypatch.setattr(repair, "PIECE", 37)
    (found,) = got(repair.report(frame(spark, rows))).values()
    kinds = bytes("sua".index(row[2][0]) + 4 * {None: 0, "truncated": 2}[f] for row, f in zip(rows, plain_faults(rows), strict=True))
    whole = list(repair.walked(kinds, repair.END, repair.STARTS, True))
    assert found[6] == "".join(w[1] for w in whole) and found[5] == sum(w[2] for w in whole)
    assert found[5] == plain_costs(kinds)


def plain_costs(kinds):
    """Least cost by a forward pass over states, apart from the operator's backward one."""
    far = 10**9
    cost = [0, far, far, far]
    def inserted(c):  # noqa: E306
        for _ in range(3):
            for s in range(4):
                to = 3 if s == 2 else 2
                c[to] = min(c[to], c[s] + 5)
        return c
    for k in kinds:  # noqa: E305
        cost, new = inserted(cost), [far] * 4
        letter, fault = "sua?"[k % 4], k // 4
        for s in range(4):
            new[s] = min(new[s], cost[s] + 2)
            if fault != 1:
                more = 5 * (fault == 2)
                to = 3 if s == 2 else 2
                new[to] = min(new[to], cost[s] + more + (0 if letter == "ua"[to - 2] else 1))
                if s == 0 and letter == "s":
                    new[1] = min(new[1], cost[s] + more)
        cost = new
    cost = inserted(cost)
    return min(cost[0], cost[3])


def test_repaired_rows(spark):
    rows = turns(40, 10, 3)
    lines = {}
    for r in repair.repaired(frame(spark, rows)).collect():
        lines.setdefault(r.conv_id, []).append(r)
    for conv, own in lines.items():
        own.sort(key=lambda r: r.place)
        assert FINE.fullmatch("".join(r.role[0] for r in own)), conv
        assert all((r.edit == "I") == (r.text == "") for r in own)


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = frame(spark, [(gone, 0, "user", "Hi.")])
    assert got(repair.report(repair.damaged(df), df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repair.report(frame(spark, [])).count() == 0 and repair.repaired(frame(spark, [])).count() == 0
