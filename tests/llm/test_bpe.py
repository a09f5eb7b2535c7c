import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from momentlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "it's  a test\n\n  x", "é" * 40 + " ça", "word " * 30_000, "line\n" * 40_000, "x y\t" * 30_000 + "  z", "ab" * 3000 + " c", "日本語 " * 20_000, "a\u0085b  c" * 9000, " " * 9000 + "a", "<|endoftext|> 12,345.67"],
)
def test_ids_are_those_of_the_library(codec, plain, text):
    ids = codec.encode(text)
    assert ids == plain.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_heap_merge_is_bpe(codec, plain):
    for piece in (b"internationalisation" * 20, "ääß".encode() * 30, b"aaaaaaaaaaaaaaaaaaaaaaa"):
        assert bpe.merge_long(piece, codec.ranks) == plain._encode_single_piece(piece)


def test_very_long_run_ends(codec):
    text = "ab" * 200_000
    assert codec.decode(codec.encode(text)) == text.encode()


def test_frames(docs, empty_docs, plain):
    got = {}
    for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        assert want in [(x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got[r.doc_id]]
    coded = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert coded.columns == [*docs.columns, "token_ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded.collect())
    assert bpe.digests(empty_docs, PATH, public_tokenizers.PATTERN).collect() == []


def test_bytes_that_are_no_utf8(spark):
    rows = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF62') AS STRING) AS text, 'x' AS n_tokens UNION ALL SELECT 2, NULL, 'y'")
    import public_tokenizers

    got = {r.doc_id: r.n_tokens for r in bpe.digests(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert got[1] > 0 and got[2] == 0


def test_texts_without_spaces_take_the_library_unless_of_one_kind():
    chinese = "我们今天去公园，然后回家。" * 400
    assert not bpe._unbroken(chinese) and bpe._unbroken("我" * 4000) and bpe._unbroken("!?" * 2000) and bpe._unbroken(" " * 4000) and bpe._unbroken("a" * 4000)
