"""Quality rules as weak votes, weighed by estimated accuracies, with built-in functions only.

Each rule looks at one figure of a text and votes good (1) or bad (-1), or abstains (0).  No rule decides
alone.  Expectation-maximisation over the table of vote patterns estimates, without labels, how often
documents are good and how often each rule votes good or bad on good and on bad ones, which is its
accuracy; the posterior probability of a document's pattern is its quality.  There are at most three to
the number of rules patterns, whatever the number of documents, so after one aggregation the iterations
work on a small table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.text_columns import SPACES, count_without, whole, words
from quillpanel.session import stage

SYMBOLS = "#*$%&|<>"
ITERATIONS = 12
KEEP = 0.5
#: Start: share of good documents, and how often a rule votes rightly and wrongly.
PRIOR, RIGHT, WRONG = 0.9, 0.4, 0.05
#: Bounds of the estimates: none is certain, and no rule votes wrongly on a class more than this part of
#: how often it gives that vote rightly.
LEAST, MOST, WORST = 0.002, 0.98, 0.5
PRIOR_LOW, PRIOR_HIGH = 0.5, 0.995
#: Documents counted in advance for each estimate, so that a rule that never votes keeps its start.
PSEUDO = 10.0


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains; both are SQL on the figures."""

    name: str
    bad: str
    good: str

    @property
    def sql(self) -> str:
        return f"case when {self.bad} then -1 when {self.good} then 1 else 0 end"


NEVER = "false"

# Figures: those of ``figures`` below.  All are whole numbers, so any SQL engine gives the same votes.
RULES = (
    Rule("short", "n_words < 50", NEVER),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words", NEVER),
    Rule("symbols", "10 * n_symbols > n_words", NEVER),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", NEVER),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", NEVER),
    Rule("capitals", "100 * n_capitals > 30 * word_chars", NEVER),
    Rule("stops", "n_stops > n_words", NEVER),
    Rule("marks", "100 * n_marks > 12 * word_chars", "100 * n_marks <= 8 * word_chars and 50 * n_symbols <= n_words and n_words > 0"),
    Rule("prose", "word_chars = 0", "word_chars >= 3 * n_words and word_chars <= 9 * n_words and 100 * n_capitals <= 10 * word_chars and 50 * n_symbols <= n_words and 3 * n_stops <= n_words"),
)


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first included.

    Windows are hashed; where two are equal, (hash, position) is sorted, equal neighbours are marked, and
    the marked windows' words are counted once each: n log n steps for a text of n words.
    """
    n = F.size(w)
    triples = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(n, F.lit(1))).alias("b"), F.slice(w, 3, F.greatest(n, F.lit(1))).alias("c")), 1, F.greatest(n - 2, F.lit(0)))
    return F.transform(triples, lambda t: F.xxhash64(t["a"], t["b"], t["c"]))


def _covered(h: Column) -> Column:
    n = F.size(h)
    numbered = F.array_sort(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), n - 1).alias("at")))
    with_next = F.arrays_zip(numbered.alias("x"), F.slice(numbered, 2, n).alias("y"))
    # Equal neighbours are marked; a run of equal windows marks all of them.
    pairs = F.filter(with_next, lambda p: p["x"]["h"] == p["y"]["h"])
    at = F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["x"]["at"], p["y"]["at"])))))
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    step = lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.least(F.lit(3), x - s["last"])).alias("sum"))
    return F.aggregate(at, first, step, lambda s: s["sum"])


def figures(docs: DataFrame) -> DataFrame:
    """Counts per row of ``docs`` (doc_id, text); a null text has none of anything."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, SPACES, "") != "")
    rows = docs.select("doc_id", whole("text").alias("_text"))
    rows = rows.select("doc_id", "_text", words(text).alias("_words"), lines.alias("_lines"))
    rows = rows.select("*", repeated_words(F.col("_words")).alias("_hashes"))
    size = lambda c: F.size(c).cast("long")
    hashes = F.col("_hashes")
    dense = F.regexp_replace(text, r"[^A-ZÀ-ÖØ-Þ]+", "")
    marks = F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")
    return rows.select(
        "doc_id",
        size("_words").alias("n_words"),
        count_without(text, SPACES).alias("word_chars"),
        (F.length(text) - count_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        size("_lines").alias("n_lines"),
        (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(size(F.array_distinct(hashes)) == size(hashes), F.lit(0).cast("long")).otherwise(_covered(hashes)).alias("n_repeat_words"),
        F.length(dense).cast("long").alias("n_capitals"),
        F.length(marks).cast("long").alias("n_marks"),
        (F.length(text) - count_without(text, ".!?")).cast("long").alias("n_stops"),
    )


@dataclass(frozen=True)
class Estimates:
    """How often documents are good; per rule how often it votes good and bad on good, and on bad documents."""

    prior: float
    on_good: tuple[tuple[float, float], ...]
    on_bad: tuple[tuple[float, float], ...]

    def log_odds(self, rules: tuple[Rule, ...]) -> Column:
        """Of a good document, from its votes."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, (gg, gb), (bg, bb) in zip(rules, self.on_good, self.on_bad, strict=True):
            v = F.col(rule.name)
            silent = math.log((1 - gg - gb) / (1 - bg - bb))
            odds = odds + F.when(v == 1, math.log(gg / bg)).when(v == -1, math.log(gb / bb)).otherwise(silent)
        return odds

    def posterior(self, rules: tuple[Rule, ...]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(rules)))


def start(rules: tuple[Rule, ...]) -> Estimates:
    return Estimates(PRIOR, ((RIGHT, WRONG),) * len(rules), ((WRONG, RIGHT),) * len(rules))


def _votes(right: float, wrong: float, of: float, right_there: float, of_there: float) -> tuple[float, float]:
    """How often a class gets its right and its wrong vote, from sums here and of the right votes there."""
    r = min(MOST, max(LEAST, (right + PSEUDO * RIGHT) / (of + PSEUDO)))
    w = max(LEAST / 2, (wrong + PSEUDO * WRONG) / (of + PSEUDO))
    there = min(MOST, max(LEAST, (right_there + PSEUDO * RIGHT) / (of_there + PSEUDO)))
    w = min(w, WORST * there)
    return r, min(w, 0.99 - r)


def estimate(votes: DataFrame, rules: tuple[Rule, ...] = RULES, iterations: int = ITERATIONS) -> Estimates:
    """Estimates from all rows of ``votes`` (a column per rule)."""
    names = [r.name for r in rules]
    patterns = stage(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "patterns").coalesce(1)
    found = start(rules)
    for _ in range(iterations):
        scored = patterns.select("*", (F.col("n") * found.posterior(rules)).alias("g")).withColumn("b", F.col("n") - F.col("g"))
        add = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0.0))
        sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("g", "b")]
        for i, r in enumerate(names):
            sums += [add(c, F.col(r) == v).alias(f"{c}{s}{i}") for c in "gb" for v, s in ((1, "g"), (-1, "b"))]
        s = scored.agg(*sums).first()
        prior = (s["g"] + PSEUDO * PRIOR) / (s["g"] + s["b"] + PSEUDO)
        good, bad = [], []
        for i in range(len(rules)):
            good.append(_votes(s[f"gg{i}"], s[f"gb{i}"], s["g"], s[f"bb{i}"], s["b"]))
            bad.append(_votes(s[f"bb{i}"], s[f"bg{i}"], s["b"], s[f"gg{i}"], s["g"])[::-1])
        found = Estimates(min(PRIOR_HIGH, max(PRIOR_LOW, prior)), tuple(good), tuple(bad))
    return found


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: float = KEEP) -> DataFrame:
    """Figures, votes, ``quality`` (posterior probability), base_failed and kept for each row of ``docs``.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows; kept: not
    base_failed and quality at least ``keep``.  A null or empty text fails.  Rows are judged each, ties and
    repeats alike; an empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    voted = stage(figures(docs).select("*", *[F.expr(r.sql).alias(r.name) for r in rules]), "votes")
    found = estimate(voted, rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = found.posterior(rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return voted.select(
        "doc_id", *counts, failed.alias("base_failed"), (~failed & (quality >= keep)).alias("kept"), F.round(quality, 6).alias("quality")
    )
