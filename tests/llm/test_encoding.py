"""Many texts at once against the tokenizers library; a piece that texts share is encoded once."""

import random

import pyarrow as pa

from quillpanel.llm.encoding import KEPT_BYTES, WordEncoder
from quillpanel.llm.queries import tokenizer_path

PARTS = [*"abzAZ019.,'\"<|>-_ \t\n\x0b\x0c\r\x00\x1c\x7f\x85\xa0\xad\xaa\xb2\xb5\xbd\xbf\xc0\xd7\xdf\xff", "'s", "'RE", "'ll", "<|endoftext|>", "é", "İ", "Σ", "日", "🙂", " ", "ﬁ", "x" * 70]


def odd_texts(n, seed=5):
    r = random.Random(seed)
    return [None, "", " ", *("".join(r.choices(PARTS, k=r.randint(1, 24))) for _ in range(n)), "the end", "THE end!"]


def test_batches_give_the_ids_of_each_text():
    texts = odd_texts(3000)
    for kept in (3, 400_000):
        encoder = WordEncoder(tokenizer_path(), cache_words=kept)
        for some in (texts, texts[:1], [], texts[40:900]):
            ids, at = encoder.encode_all(pa.array(["cut off", *some], pa.string()).slice(1))
            assert len(at) == len(some) + 1 and at[0] == 0 and at[-1] == len(ids)
            for text, a, b in zip(some, at[:-1], at[1:], strict=True):
                assert ids[a:b].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
            for table in (encoder.words, encoder.units):
                assert len(table.names) == len(table.kept) == len(table.last) <= kept
                assert all(len(p.encode()) <= KEPT_BYTES for p in table)


def test_a_piece_is_encoded_once():
    encoder, met = WordEncoder(tokenizer_path()), []
    model = encoder._unit
    encoder.units.encode = lambda piece: met.append(piece) or model(piece)
    texts = pa.array(["Stone stone, STONE! (stone)", "stone; don't \xc9t\xe9 \xe9t\xe9."])
    for _ in range(2):
        encoder.encode_all(texts)
    assert len(met) == len(set(met)) and {"stone", "don", "'t", "été"} <= set(met)
