"""Probability of whole texts under a subword unigram model, over all segmentations.

The pieces are those of an existing subword vocabulary, and its scores give their first weights.  A word,
with its leading blank as part of it, is a lattice: each piece that occurs in it is an edge.  Forward
recursion in log space sums over all paths, so a word's probability is that of all its segmentations
together; pieces never cross words, so a text's probability is the product over its words and one end.
The weights are fitted to the training documents by expectation-maximisation: forward and backward sums
give each piece's expected uses over all training words, each distinct word once, times its count.

Counting, fitting and scoring all run on tables of distinct words that grow with the corpus.  Words in
very many documents are a bounded list that every task holds; all other words of a document meet their
probabilities in a join by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.batches import column, slices, utf8
from quillpanel.llm.words import U
from quillpanel.session import stage

ITERATIONS = 3
#: Uses that each piece has in advance.
PSEUDO = 0.05
#: Bound of the list of frequent words that every task holds.
HEAD = 200_000
#: A vocabulary with longer pieces is refused; sums go up to the longest piece that it has.
LONGEST_PIECE = 256
#: Longer words are summed one by one instead of in batches of equal length.
LONG_WORD = 64
BATCH = 8192
FLUSH_WORDS = 300_000
BLANK = b" "
BASE = U(0x100000001B3)

SCORES = "row binary, word binary, n long, doc_id long, held_out boolean, n_tokens long, known long, base double, lat double"


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file as bytes, with a blank for the word mark, and their scores.

    Control and unknown pieces are left out; every single byte is a piece, so that any text has a path.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        text = model.id_to_piece(i)
        piece = bytes([int(text[1:-1], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()
        if len(piece) > LONGEST_PIECE:
            raise ValueError(f"a piece of {len(piece)} bytes; at most {LONGEST_PIECE} are supported")
        if piece and BLANK not in piece[1:]:
            found.setdefault(piece, model.get_score(i))
    least = min(found.values(), default=0.0)
    for b in range(256):
        found.setdefault(bytes([b]), least)
    pieces = sorted(found)
    return pieces, np.array([found[p] for p in pieces])


def start_weights(scores: np.ndarray) -> np.ndarray:
    """Log weights by the vocabulary's scores: the k-th best score has a weight in proportion to 1 / (k + 10)."""
    place = np.empty(len(scores))
    place[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    w = 1 / (place + 10)
    return np.log(w / w.sum())


class Lattice:
    """Edges of many words at once.  ``table`` is that of an earlier Lattice of the same pieces."""

    def __init__(self, pieces: list[bytes], table: tuple[np.ndarray, np.ndarray] | None = None):
        self.pieces, self.number = pieces, {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.keys, self.values = table or self._table()

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all pieces and what begins them, by open addressing, with the piece's number or -1."""
        value: dict[int, int] = {}
        for p in self.pieces:
            for n in range(1, len(p)):
                value.setdefault(self._hash(p[:n]), -1)
        for i, p in enumerate(self.pieces):
            value[self._hash(p)] = i
        size = 1 << int(4 * len(value)).bit_length()
        self.keys = np.zeros(size, U)
        values = np.full(size, -1, np.int32)
        for at, (k, v) in zip(self._place(np.array(list(value), U)).tolist(), value.items(), strict=True):
            while self.keys[at]:
                at = (at + 1) & (size - 1)
            self.keys[at], values[at] = k, v
        return self.keys, values

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(65 - len(self.keys).bit_length())).astype(np.int64)

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash begins a piece, and the piece it is (-1: none)."""
        at = self._place(keys)
        there = self.keys[at]
        found = there == keys
        open_ = np.flatnonzero(~found & (there != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at[open_]]
            found[open_] = there == keys[open_]
            open_ = open_[~found[open_] & (there != 0)]
        return found, np.where(found, self.values[at], -1)

    def edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, pieces) over all words of one length, by begin."""
        letters = np.ascontiguousarray(words.T).astype(U) + U(1)
        length, n = letters.shape
        out = []
        for begin in range(length):
            rows, h = np.arange(n), letters[begin]
            for end in range(begin + 1, min(begin + self.longest, length) + 1):
                if end > begin + 1:
                    h = h * BASE + letters[end - 1][rows]
                found, piece = self._look(h)
                whole = np.flatnonzero(piece >= 0)
                if len(whole):
                    out.append((begin, end, rows[whole], piece[whole]))
                if not found.any():
                    break
                rows, h = rows[found], h[found]
        return out

    @staticmethod
    def forward(n: int, length: int, edges: list, log_p: np.ndarray, backward: bool = False) -> list[np.ndarray]:
        """Per position the log sum over all ways from the words' begin to it, or from it to the words' end."""
        a = [np.full(n, -np.inf) for _ in range(length + 1)]
        a[length if backward else 0][:] = 0
        for begin, end, rows, piece in reversed(edges) if backward else edges:
            to, of = (a[begin], a[end]) if backward else (a[end], a[begin])
            if len(rows) == n:
                np.logaddexp(to, of + log_p[piece], out=to)
            else:
                to[rows] = np.logaddexp(to[rows], of[rows] + log_p[piece])
        return a

    def expected(self, words: np.ndarray, counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in all ``words``, each ``counts`` times."""
        edges = self.edges(words)
        a, b = (self.forward(*words.shape, edges, log_p, way) for way in (False, True))
        uses = np.zeros(len(log_p))
        scale = np.log(counts) - a[-1]
        for begin, end, rows, piece in edges:
            share = np.exp(a[begin][rows] + log_p[piece] + b[end][rows] + scale[rows])
            uses += np.bincount(piece, share, len(log_p))
        return uses

    def long_edges(self, word: bytes) -> list[tuple[int, int, int]]:
        return [
            (i, j, k)
            for i in range(len(word))
            for j in range(i + 1, min(i + self.longest, len(word)) + 1)
            if (k := self.number.get(word[i:j])) is not None
        ]

    def long_sums(self, word: bytes, edges: list, log_p: np.ndarray, backward: bool = False) -> np.ndarray:
        a = np.full(len(word) + 1, -np.inf)
        a[-1 if backward else 0] = 0
        for i, j, k in reversed(edges) if backward else edges:
            to, of = (i, j) if backward else (j, i)
            a[to] = np.logaddexp(a[to], a[of] + log_p[k])
        return a


def _by_length(words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Indexes and bytes of words of one length, a leading blank added, in batches."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) <= LONG_WORD:
            groups.setdefault(len(w), []).append(i)
    for length, all_ in groups.items():
        for at in range(0, len(all_), BATCH):
            own = all_[at : at + BATCH]
            yield own, np.frombuffer(b"".join(BLANK + words[i] for i in own), np.uint8).reshape(len(own), length + 1)


def word_scores(words: list[bytes], lattice: Lattice, log_p: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability over all segmentations."""
    out = np.zeros(len(words))
    for own, block in _by_length(words):
        out[own] = lattice.forward(*block.shape, lattice.edges(block), log_p)[-1]
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            w = BLANK + w
            out[i] = lattice.long_sums(w, lattice.long_edges(w), log_p)[-1]
    return out


def word_uses(words: list[bytes], counts: np.ndarray, lattice: Lattice, log_p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all words."""
    uses = np.zeros(len(log_p))
    for own, block in _by_length(words):
        uses += lattice.expected(block, counts[own], log_p)
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            w = BLANK + w
            edges = lattice.long_edges(w)
            a, b = lattice.long_sums(w, edges, log_p), lattice.long_sums(w, edges, log_p, True)
            for p, q, k in edges:
                uses[k] += counts[i] * np.exp(a[p] + log_p[k] + b[q] - a[-1])
    return uses


def split_words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lowered: bytes between 20 and 09-0D."""
    return text.lower().split()


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with how often training texts have them (0: only others do)."""
    counts: Counter[bytes] = Counter()

    def batch_of(c: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

    for batch in slices(batches):
        for text, held in zip(utf8(column(batch, "text")), column(batch, "held_out"), strict=True):
            words = split_words(text)
            if held:
                dict.update(counts, dict.fromkeys([w for w in words if w not in counts], 0))
            else:
                counts.update(words)
        if len(counts) > FLUSH_WORDS:
            yield batch_of(counts)
            counts = Counter()
    yield batch_of(counts)


def _uses(shared, weights):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, log_p = Lattice(*shared.value), weights.value
        uses = np.zeros(len(log_p))
        for batch in slices(batches, rows=100_000):
            uses += word_uses(column(batch, "word"), batch.column(1).to_numpy().astype(np.float64), lattice, log_p)
        k = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(uses[k])], ["piece", "uses"])

    return run


def _score_words(shared, weights):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, log_p = Lattice(*shared.value), weights.value
        for batch in slices(batches, rows=100_000):
            lp = word_scores(column(batch, "word"), lattice, log_p) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp)], ["word", "c", "lp"])

    return run


def fit(vocab: DataFrame, ends: int, shared, scores: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, float]:
    """Log weights of the pieces, and of the end, from ``vocab`` (word, c) and the number of training texts.

    ``shared`` is a broadcast of the pieces and their lattice's table.
    """
    spark = vocab.sparkSession
    log_p, log_end = start_weights(scores), 0.0
    for _ in range(iterations):
        weights = spark.sparkContext.broadcast(log_p)
        found = vocab.where("c > 0").mapInArrow(_uses(shared, weights), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full(len(scores), PSEUDO)
        uses[found.piece.to_numpy()] += found.uses.to_numpy()
        total = uses.sum() + ends + PSEUDO
        log_p, log_end = np.log(uses / total), float(np.log((ends + PSEUDO) / total))
    return log_p, log_end


def frequent(vocab: DataFrame, most: int = HEAD) -> DataFrame:
    """The words of the highest counts, as many whole classes of counts as have at most ``most`` words together."""
    step = F.floor(F.log2(F.col("c")) * 8).cast("int")
    sizes = vocab.where("c > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("step", ascending=False)
    fits = sizes[sizes.n.cumsum() <= most]
    lowest = int(fits.step.min()) if len(fits) else 1 << 30
    return vocab.where("c > 0").where(step >= lowest)


def _document_rows(shared):
    """Per text a row with what the frequent words and the end add, and a row for each other word.

    The first kind has a word that begins with a blank, which no word has, so it joins with nothing.  A row's
    key is a digest of the document, so that a task that runs again, with its input in another order, gives
    the same rows; the partition's number is part of it, which keeps repeated rows of a large table apart.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, lat, base_end, lat_end, end_known = shared.value
        place = {w: i for i, w in enumerate(words)}
        part = TaskContext.get().partitionId()
        names = [c.split()[0] for c in SCORES.split(", ")]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in slices(batches):
            out: list[list] = [[] for _ in names]
            rest_rows, rest_words, rest_n = [], [], []
            for text, held, doc in zip(utf8(column(batch, "text")), column(batch, "held_out"), column(batch, "doc_id"), strict=True):
                found = split_words(text)
                counts = Counter(found)
                row = blake2b(text, digest_size=16, key=b"%d %r" % (part, doc)).digest()
                k = np.array([place.get(w, -1) for w in counts], np.int64)
                n = np.array(list(counts.values()), np.int64)
                own, other = k >= 0, np.flatnonzero(k < 0)
                if len(other):
                    keys = list(counts)
                    rest_words += [keys[i] for i in other.tolist()]
                    rest_rows += [row] * len(other)
                    rest_n.append(n[other])
                k, n = k[own], n[own]
                values = (row, BLANK + row, 0, doc, held, len(found) + 1, int(n.sum()) + end_known, float(n @ base[k]) + base_end, float(n @ lat[k]) + lat_end)
                for o, v in zip(out, values, strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)
            if rest_words:
                none = [pa.nulls(len(rest_words), k) for k in kinds[3:]]
                rest = [pa.array(rest_rows, pa.binary()), pa.array(rest_words, pa.binary()), pa.array(np.concatenate(rest_n)), *none]
                yield pa.RecordBatch.from_arrays(rest, names)

    return run


def is_held_out(doc_id: Column | str, parts: int = 5, held: int = 1) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(parts)) == held, F.lit(False))


def score(docs: DataFrame, vocabulary_path: str, iterations: int = ITERATIONS, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    Held out from training: documents whose crc32 of the doc_id is 1 modulo 5; a null doc_id is not.  A
    null or empty text is its end alone; repeated rows count and are scored each; without any training
    text all pieces have their first weights and the end probability 1.  An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", is_held_out("doc_id").alias("held_out"))
    ends = docs.where("not held_out").count()
    counted = docs.select("text", "held_out").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    vocab = stage(counted, "vocabulary")
    of = vocab.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    train_tokens, kinds = (of["n"] or 0) + ends, (of["v"] or 0) + (ends > 0)
    room = train_tokens + 0.5 * (kinds + 1)
    pieces, scores = vocabulary(vocabulary_path)
    lattice = Lattice(pieces)
    shared = spark.sparkContext.broadcast((pieces, (lattice.keys, lattice.values)))  # the vocabulary's size
    log_p, log_end = fit(vocab, ends, shared, scores, iterations)
    weights = spark.sparkContext.broadcast(log_p)
    scored = stage(vocab.mapInArrow(_score_words(shared, weights), "word binary, c long, lp double"), "scored")
    top = frequent(scored, head).toArrow()
    base = lambda c: np.log10((np.asarray(c, np.float64) + 0.5) / room)
    known = (column_of(top, "word"), base(column_of(top, "c")), np.array(column_of(top, "lp"), np.float64), float(base(ends)), log_end / float(np.log(10)), int(ends > 0))
    rows = docs.mapInArrow(_document_rows(spark.sparkContext.broadcast(known)), SCORES)
    joined = rows.join(scored, "word", "left")
    n = F.col("n")
    per_word = lambda x: F.when(n > 0, n * x)
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", per_word((F.col("c") > 0).cast("long")))).alias("n_known"),
        F.sum(F.coalesce("base", per_word(F.log10((F.col("c") + 0.5) / F.lit(float(room)))))).alias("base_score"),
        F.sum(F.coalesce("lat", per_word(F.col("lp")))).alias("score"),
        F.count("n_tokens").alias("times"),  # rows that repeat doc_id and text are one sum, taken so often
    )
    each = lambda c: F.when(F.col("times") == 1, F.col(c)).otherwise(F.col(c) / F.col("times")).alias(c)
    one = sums.select("doc_id", "held_out", "n_tokens", (F.col("n_known") / F.col("times")).cast("long").alias("n_known"), each("base_score"), each("score"), "times")
    rows = one.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def column_of(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()
