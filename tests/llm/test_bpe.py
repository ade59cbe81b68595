import random

import numpy as np
import pytest

from wayloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.vocabulary_path()
    return bpe.Encoder(bpe.vocabulary(path)), tokenizers.Tokenizer.from_file(path)


def test_equals_the_library(both):
    enc, ref = both
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "a", "the", "'s", "'", "1", "é", "中", " ", "\t", "<|endoftext|>", "\x00", "xx", "XXXX", "!!", "՘", "😀", "　", "-", "aaaa", "\r\n", "123"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)] + ["", "x" * 5000, " " * 300, "ab " * 2000, "<|endoftext|>", " a", "a "]
    want = [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == want
    for text, ids in zip(texts, want):
        assert bpe.decode(np.array(ids), enc.voc) == ref.decode(ids, skip_special_tokens=False) == text


def test_every_script_is_split_as_the_library_splits_it():
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    rng = random.Random(2)
    rims = [int(x, 16) for r in bpe._NEWER.split() for x in r.split("-")]
    near = [c for x in rims for c in (x - 1, x, x + 1)]
    for _ in range(3000):
        some = [rng.choice(near) if rng.random() < 0.5 else rng.choice([rng.randrange(0x20, 0x3100), rng.randrange(0xA000, 0xD800), rng.randrange(0x10000, 0x33500)]) for _ in range(8)]
        text = "".join(chr(c) + rng.choice(["", "", " ", "a", "1", "."]) for c in some)
        assert bpe.pretokens(text) == [text[s:e] for _, (s, e) in split(text)], [hex(c) for c in some]


def test_cache_limit(both):
    small = bpe.Encoder(both[0].voc, max_pieces=3)
    for text in ("one two three four", "five six", "one two"):
        assert small.encode([text])[0].tolist() == both[0].encode([text])[0].tolist()


def test_odd_rows(spark, odd, none):
    path = bpe.vocabulary_path()
    out = bpe.digests(odd, path)
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.columns == [*[c for c in odd.columns if c not in new], *new]
    assert out.select("n_tokens").schema[0].dataType.simpleString() == "bigint"
    import hashlib

    for r in out.collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and (r.n_tokens == 0) == (not r.text)
    back = bpe.decoded(bpe.encode(odd.select("doc_id", "text"), path), path)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert bpe.digests(none, path).count() == 0
