import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from common_cases import LONG, ROWS, awkward, empty

from quiremill.llm import alignment as L
from quiremill.llm.queries import QUERIES

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def tokens(text):
    """Both sides as (id, bytes) by the tokenizer libraries, or None."""
    t, p = tokenizers()
    if not text:
        return None
    char = {c: b for b, c in enumerate(L._byte_characters())}
    a = [(i, bytes(char[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in p.encode(text):
        piece = p.id_to_piece(i)
        b.append((i, bytes.fromhex(piece[3:5]) if p.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else None


def groups(text):
    """[(A ids, B ids)] by walking over both sides."""
    found = tokens(text)
    if found is None:
        return []
    ends = []
    for side in found:
        at = 0
        ends.append({at := at + len(x) for _, x in side})
    both = ends[0] & ends[1]
    out = []
    for side in found:
        parts, part, at = [], [], 0
        for i, x in side:
            part.append(i)
            at += len(x)
            if at in both:
                parts.append(part)
                part = []
        out.append(parts)
    return list(zip(*out))


def plain(rows):
    """The rule in plain Python: counter of the rows of the result, with the groups as text."""
    per, count = [], Counter()
    for i, text in rows:
        g = groups(text)
        links = Counter((a, b) for x, y in g for a in x for b in y)
        count.update(links.keys())
        per.append((i, g, links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return Counter((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()),
                    sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()),
                    ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) for i, g, links in per)


def found(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


def texts(n=60, seed=2):
    rng = random.Random(seed)
    pool = ["der", "Größe", "conversion", "PDF", "▁", "<|endoftext|>", "<0x41>", "<s>", "12345", "漢字", "한글", "😀", "é", " ", "=====",
            "....", "\n\n", "\t", "  ", "tokenization", "ﬁ", "\x01", "x" * 40]
    rows = [(i, rng.choice(["", " "]).join(rng.choices(pool, k=rng.randrange(1, 30)))) for i in range(n)]
    plain_words = [(n + i, " ".join(rng.choices(["the", "converted", "document", "naïve", "Straße", "unbelievably"], k=rng.randrange(1, 80)))) for i in range(n)]
    return rows + plain_words


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_rule(spark):
    rows = texts()
    want = plain(rows)
    assert sum(r[1] == 0 for r in want) > 5 and sum(r[1] > 0 for r in want) > 60
    assert found(L.align_tokens(table(spark, rows), BPE, PIECES)) == want


@pytest.mark.parametrize("hot", [0, 20, 100])
def test_pairs_beyond_the_bound_meet_in_a_join(spark, hot):
    rows = texts(30, 4)
    assert found(L.align_tokens(table(spark, rows), BPE, PIECES, hot_pairs=hot)) == plain(rows)


def test_small_chunks(spark, monkeypatch):
    """Products and bytes in many stretches give the same."""
    pair = L.Pair(BPE, PIECES)
    some = [t for _, t in texts(40, 8)] + [LONG[:3000], None, ""]
    want = L._align(pair, some)
    monkeypatch.setattr(L, "STRETCH", 50)
    monkeypatch.setattr(L.product, "__defaults__", (7,))
    for x, y in zip(L._align(pair, some), want):
        assert x[:5] == y[:5] and all((u == v).all() for u, v in zip(x[5:], y[5:]))


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.integers(0, 3, (7, 9)), rng.integers(0, 3, (9, 5))
        sparse = [L.incidence(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (x, y)]
        for got, want in ((L.product(*sparse, expand=4), x @ y), (L.transposed(sparse[0]), x.T)):
            dense = np.zeros(want.shape, np.int64)
            dense[np.repeat(np.arange(len(want)), np.diff(got.start)), got.columns] = got.values
            assert (dense == want).all()


def test_ids_are_those_of_the_tokenizer_libraries():
    """Every character, and random bytes' worth of text, between other characters."""
    pair, (t, _) = L.Pair(BPE, PIECES), tokenizers()
    rng = random.Random(6)
    some = [f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'s" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    some += ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x3000), rng.randrange(0xD800)])) for _ in range(200)) for _ in range(300)]
    for x, e in zip(some, t.encode_batch(some, add_special_tokens=False)):
        assert pair.ranks.encode_ordinary(x) == e.ids


def test_long_blanks_and_long_words():
    pair = L.Pair(BPE, PIECES)
    for text in ("a" + " " * 300_000 + "b", "x" * 300_000, "\n" * 50_000):
        (n_a, n_b, n_groups, *_), = L._align(pair, [text])
        assert (n_groups > 0) == (tokens(text) is not None) and (not n_groups or n_groups == len(groups(text)))


def test_awkward_documents(spark):
    assert found(L.align_tokens(awkward(spark), BPE, PIECES)) == plain(ROWS)


def test_a_third_of_all_rows_are_one_text(spark):
    rows = [(i, "the converted document" if i % 3 else f"own text {i}") for i in range(300)]
    assert found(L.align_tokens(table(spark, rows), BPE, PIECES, hot_pairs=5)) == plain(rows)


def test_empty(spark):
    assert L.align_tokens(empty(spark), BPE, PIECES).count() == 0


def test_query(spark, tmp_path):
    rows = texts(25, 12) + [(900, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
                  for r in QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect())
    assert got == Counter({(*r[:7], r[7] and hashlib.sha256(r[7].encode()).hexdigest()): n for r, n in plain(rows).items()})
