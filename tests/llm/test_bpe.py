import hashlib
import random

import pytest

from tunemill.llm import bpe
from tunemill.llm.queries import tokenizer_ranks

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", "a", " ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x" * 5000, "  \n\n  \t " * 300, "日本語テキスト" * 400, "it's we'll  don't " * 200, "a | b | c " * 300, "    z" * 100, "ab cd\x00 ef " * 500, "é à ü " * 400, "🙂 👍🏽" * 300]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(5)
    words = ["the", "Of", "l'été", "12345", "don't", "\n", "  ", "a-b", "ß", "x=1;", "“q”", "漢字", "...", "I'm", "\t"]
    shared = " ".join(rng.choice(words) for _ in range(300))
    return [*ODD, *(rng.choice(["", shared]) + " ".join(rng.choice(words) for _ in range(rng.randrange(400))) + shared for _ in range(60))]


@pytest.mark.parametrize("chunk", [16, 256])
def test_ids_equal_the_library(library, chunk):
    coder = bpe.ChunkEncoder(tokenizer_ranks(), chunk)
    for t in texts():
        ids = list(coder.encode(t))
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == t
    assert coder.reused > 0


def test_small_memory_is_still_exact(library):
    coder = bpe.ChunkEncoder(tokenizer_ranks(), 32, keep=3)
    assert all(list(coder.encode(t)) == library.encode(t, add_special_tokens=False).ids for t in texts())


def test_cuts_depend_on_content_only():
    a, b = b"some words that go before ", b"the same long passage of text " * 200
    ends = bpe.cuts(b, 64)
    assert {e + len(a) for e in ends if e > 16} <= set(bpe.cuts(a + b, 64))


def test_rows(spark):
    rows = [(1, None), (None, "one two"), (3, "one two"), (3, "")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    out = bpe.encode_documents(df, tokenizer_ranks()).collect()
    assert [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in out] == [(i, 2 if t else 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert out[0].ids_sha256 == hashlib.sha256(b"").hexdigest() and len(out[1].ids) == 2
    assert bpe.encode_documents(df.limit(0), tokenizer_ranks()).collect() == []
