"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size string, `k` int, spans string, n_tokens int, own string"


def prose(seed: int, words: int = 80) -> str:
    r = random.Random(seed)
    parts = ["the", "of", "ing", "re", "an", "tion", "er", "st", "nd", "ha"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    text = " ".join(word() for _ in range(words))
    return text[:1].upper() + text[1:] + "."


def documents() -> list[tuple]:
    texts = [prose(i, 30 + 7 * i) for i in range(12)]
    near = texts[3].split()
    near[5] = "changed"
    texts += [texts[3], " ".join(near), texts[3].upper(), "", None, " \t\n ", "one two", "one  TWO\n", prose(99, 6000), "é" * 300, "a\x00b 日本語 ΑΣ <|endoftext|>"]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "ü", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[2], "en", "a", 3), (None, None, None, None, None)]
    return [(*r, 7, "x", 1, "own", 2, "y") for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return frame(spark, [])
