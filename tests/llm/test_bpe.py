import array
import base64
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from common_cases import LONG, ROWS, awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from quiremill.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Codec(RANKS, P.PATTERN)


def ids(text):
    out = array.array("i")
    out.frombytes(OURS.encode(text))
    return out.tolist()


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids(text)) == text.encode("utf-8", "surrogatepass")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tabcdehinorstLL'.,!019é漢"))
def test_text_of_few_signs(text):
    assert ids(text) == THEIRS.encode_ordinary(text)


def test_words_that_need_backtracking():
    rnd = random.Random(4)
    for _ in range(500):
        word = "".join(rnd.choice("aeinorstlhdcumbgpfwyv") for _ in range(rnd.randint(1, 400)))
        assert OURS.piece_ids(word.encode()) == THEIRS.encode_ordinary(word)


@pytest.mark.parametrize("piece", ["a" * 100_000, "ab" * 50_000, "the" * 30_000, " " * 5_000, "漢字" * 10_000])
def test_long_pieces(piece):
    assert ids(piece) == THEIRS.encode_ordinary(piece)


def test_small_memo_gives_the_same(monkeypatch):
    small = bpe.Codec(RANKS, P.PATTERN)
    small.words.limit = small.pieces.limit = small.fits.limit = 3
    text = LONG[:2000] + " the quick brown fox, jumps"
    assert small.encode(text) == OURS.encode(text)


def test_ranks_are_bounded(tmp_path, monkeypatch):
    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    assert len(bpe.read_ranks(str(tmp_path / "r"))) == 256
    monkeypatch.setattr(bpe, "MAX_VOCABULARY", 100)
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "r"))


def test_awkward_documents(spark):
    got = bpe.encode_documents(awkward(spark), PATH, P.PATTERN, with_content=True)
    assert got.columns == ["doc_id", "token_ids", "n_tokens", "content"]
    want = Counter((i, tuple(THEIRS.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)
    assert Counter((r.doc_id, tuple(r.token_ids), bytes(r.content)) for r in got.collect()) == want
    back = bpe.decode_documents(got.select("doc_id", "token_ids"), PATH)
    assert Counter((r.doc_id, bytes(r.content)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in ROWS)
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    assert {bytes(r.content) for r in bpe.decode_documents(nulls, PATH).collect()} == {b""}
    assert bpe.encode_documents(empty(spark), PATH, P.PATTERN).count() == 0


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_documents(docs, PATH, P.PATTERN).collect():
        assert r.token_ids == THEIRS.encode_ordinary(texts[r.doc_id])
