"""The codec against the tiktoken library, and exact round trips."""

import hashlib
import random
import sys

import public_tokenizers as P
import pytest
import tiktoken

from logweir.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.codec(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_every_code_point(codec, library):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    for form in ("a{}b", "1{}{}2", " {} x"):
        for i in range(0, len(points), 256):
            text = "|".join(form.format(c, c) for c in points[i : i + 256])
            assert codec.encode(text).tolist() == library.encode_ordinary(text), (form, i)


@pytest.mark.parametrize("seed", range(5))
def test_random_texts_and_long_pre_tokens(codec, library, seed):
    rng = random.Random(seed)
    for alphabet in ("ab", "etaoin ", "aé ñ\n\t", "0123 ", "=-_#", "日本語 ", "‍😀🏽"):
        for n in (0, 1, 2, 3, 17, 400, 3000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = codec.encode(text).tolist()
            assert ids == library.encode_ordinary(text)
            assert codec.decode(ids).decode() == text


def test_very_long_single_run(codec):
    text = "ab" * 100_000 + "a" * 100_000
    assert codec.decode(codec.encode(text)).decode() == text


def test_documents_with_odd_rows(spark, codec):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello <|endoftext|> world", None), (3, "Hello <|endoftext|> world", None), (None, "  \n a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(docs, PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = codec.encode(r.text or "").tolist()
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.where("false"), PATH, P.PATTERN).count() == 0
