"""The byte-level encoder against the library's own encoding of whole texts, rare characters included."""

import random

import pyarrow as pa
import pytest

pytest.importorskip("rillstone.llm")
import public_tokenizers
from tokenizers import Tokenizer

from rillstone.llm.chunks import WordCache
from rillstone.llm.token_store import byte_bpe, raw

PARTS = [*"abZ 9,.'  \n\t\r\0\x0b\x1c\x7f\x85\xa0²ªéßÆ“—日я", "'ll", "'s", " don't", "<|endoftext|>", "  ", "\n\n", "🙂"]


def test_same_ids_as_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encode, rng = Tokenizer.from_file(path), byte_bpe(path), random.Random(7)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(6000)]
    ids, counts = encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [x for y in want for x in y]


def test_other_forms_are_encoded_by_the_library_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some words, SOME words", "", None, "a  b\n c"]
    ids, counts = byte_bpe(path)(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [x for y in want for x in y]


def test_a_full_cache_forgets_and_stays_right():
    import numpy as np

    cache, rng = WordCache(lambda chunks: [[len(c), *c.encode()] for c in chunks], 300), random.Random(1)
    for _ in range(40):
        texts = [" ".join(rng.choice("abé") * rng.randrange(1, 12) + str(rng.randrange(400)) for _ in range(rng.randrange(9))) for _ in range(20)]
        data, off = raw(pa.array(texts))
        ids, n = cache.ids(data, off, np.zeros(len(texts), bool))
        want = [[i for k, w in enumerate(t.split(" ")) for c in [(" " if k else "") + w] for i in (len(c), *c.encode())] if t else [] for t in texts]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
