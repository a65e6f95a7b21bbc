"""Token ids of whole texts from an existing tokenizer file, looked up piece by piece.

The tokenizer ``word_bpe_49k`` drops white space and never joins pieces across it, so the ids of a text
are the ids of its words in order.  Most words of a corpus are repeats: the words of a batch of texts are
numbered by Arrow, and only the distinct ones are cut and looked up.  Words of plain Latin letters, digits
and signs are cut by the tokenizer's own pattern and their pieces go to its BPE model directly; any other
word takes the library's full path (normalisation, special strings).  Both give what encoding the whole text
gives.  A worker keeps the ids of pieces in tables of bounded size, for the tasks of such operators that it
runs later.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillpanel.llm.batches import worker_tables

#: Pieces that each of two tables keeps; longer ones than KEPT_BYTES are not, so that they are bounded.
CACHE_WORDS, KEPT_BYTES = 400_000, 64
ENCODER = "encoder"
END_ID = 1
#: Rows and bytes of texts that are encoded at once: each time the tables are hashed anew.
ENCODED_ROWS, ENCODED_BYTES = 10_000, 8 << 20

# The tokenizer's split pattern, what it comes to without an apostrophe, and the characters that
# take the short path (no marks to compose, no white space, lower case of one character each).
SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+)"
SIGNS = r"([\p{N}]|[^\s\p{L}\p{N}]+)"
PLAIN = r"^[\x21-\x7e\x{a1}-\x{ac}\x{ae}-\x{ff}]*$"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _lists(ids: list[list[int]]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, at[-1])))


class Pieces:
    """Ids of pieces by ``encode``; those met last are kept, at most ``most``."""

    def __init__(self, encode: Callable[[str], list[int]], most: int):
        self.encode, self.most = encode, most
        self.names, self.kept = pa.array([], pa.string()), _lists([])
        self.last, self.turn = np.array([], np.int64), 0  # when each was met last

    def __iter__(self) -> Iterator[str]:
        return iter(self.names.to_pylist())

    def ids(self, pieces: pa.StringArray) -> pa.ListArray:
        """Of each of ``pieces``, which are distinct."""
        at = pc.index_in(pieces, self.names)
        new = pieces.filter(at.is_null())
        at = at.to_numpy(zero_copy_only=False)
        at = np.where(np.isnan(at), -1, at).astype(np.int64) if at.dtype.kind == "f" else at.astype(np.int64)
        at[at < 0] = len(self.names) + np.arange(len(new))
        if len(new):
            self.names = pa.concat_arrays([self.names, new])
            self.kept = pa.concat_arrays([self.kept, _lists([self.encode(p) for p in new.to_pylist()])])
            self.last = np.append(self.last, np.zeros(len(new), np.int64))
        self.turn += 1
        self.last[at] = self.turn
        found = self.kept.take(pa.array(at))
        if len(new):
            keep = np.flatnonzero(pc.binary_length(self.names).to_numpy() <= KEPT_BYTES)
            if len(keep) > self.most:  # half of the room is free for the next ones
                keep = keep[np.argsort(self.last[keep], kind="stable")[len(keep) - self.most // 2 :]]
            if len(keep) < len(self.names):
                self.names, self.kept, self.last = self.names.take(pa.array(keep)), self.kept.take(pa.array(keep)), self.last[keep]
        return found


class WordEncoder:
    """Ids of texts."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words = Pieces(self._whole, cache_words)
        self.units = Pieces(self._unit, cache_words)

    def _unit(self, unit: str) -> list[int]:
        """Ids of a lower-case piece between the tokenizer's cuts."""
        text = unit if unit.isascii() else "".join(map(self.letters.__getitem__, unit.encode()))
        return [t.id for t in self.model.tokenize(text)]

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _plain(self, words: pa.StringArray) -> pa.ListArray:
        low = pc.utf8_lower(words)
        quoted = pc.match_substring(low, "'")
        signs = pc.and_not(pc.invert(pc.utf8_is_alpha(low)), quoted)  # letters alone are one piece
        for mask, pattern, cut in ((quoted, SPLIT, r"\1 "), (signs, SIGNS, r" \1 ")):
            low = pc.replace_with_mask(low, mask, pc.replace_substring_regex(low.filter(mask), pattern, cut))
        cut = pc.split_pattern(low, " ")
        units = cut.values.dictionary_encode()
        ids = self.units.ids(units.dictionary).take(units.indices)
        return pa.ListArray.from_arrays(ids.offsets.take(cut.offsets), ids.values)

    def _distinct(self, words: pa.StringArray) -> pa.ListArray:
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))
        ids = pa.concat_arrays([self._plain(words.filter(plain)), self.words.ids(words.filter(pc.invert(plain)))])
        return ids.take(pa.array(np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"))))

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each begins and the last one ends; a null text is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words = split.values.dictionary_encode()
        ids = self._distinct(words.dictionary).take(words.indices)
        return ids.values.to_numpy().view(np.uint32), ids.offsets.to_numpy()[split.offsets.to_numpy()].astype(np.int64)

    def encode(self, text: bytes) -> bytes:
        """Ids of one UTF-8 text as little-endian unsigned 32-bit bytes."""
        return self.encode_all(pa.array([text.decode()], pa.string()))[0].astype("<u4").tobytes()


def worker_encoder(path: str) -> WordEncoder:
    """This worker's encoder for ``path``, made by its first task and dropped by another operator's."""
    tables = worker_tables()
    if (ENCODER, path) not in tables:
        tables[ENCODER, path] = WordEncoder(path)
    return tables[ENCODER, path]
