import random

import public_tokenizers as P
from common_cases import ROWS, awkward, empty

from quiremill.llm import bpe
from quiremill.llm import token_counts as T

PATH = P.path("byte_bpe_50k.tiktoken")
CODEC = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
PARTS = ["the", "an", "ing", " ", "  ", "\n", ".", "'s", "9", "漢", " a", " of"]


def count(t):
    return len(CODEC.encode(t)) // 4


def test_edits_against_a_full_count():
    rnd = random.Random(2)
    for _ in range(400):
        t = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 200)))
        leaves = T.leaves_of(t, rnd.choice([1, 5, 40]))
        tree = T.TokenTree(leaves, [count(x) for x in leaves], count)
        assert "".join(leaves) == t and tree.total() == count(t)
        for _ in range(6):
            begin = rnd.randint(0, len(t) + 2)
            end = rnd.randint(begin - 1, begin + 30)
            new = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 8)))
            tree.replace(begin, end, new)
            b = min(begin, len(t))
            t = t[:b] + new + t[min(max(end, b), len(t)):]
            assert "".join(tree.leaves) == t and tree.total() == count(t)


def test_only_touched_leaves_are_encoded():
    t = "some words in a row " * 2000
    leaves = T.leaves_of(t)
    tree = T.TokenTree(leaves, [count(x) for x in leaves], count)
    tree.replace(20_000, 20_005, "other")
    assert tree.encoded < 4 * T.LEAF and tree.total() == count("".join(tree.leaves))


def test_awkward_documents(spark):
    trees = T.token_trees(awkward(spark), PATH, P.PATTERN)
    assert sorted(r.n_tokens for r in trees.collect()) == sorted(count(t or "") for _, t in ROWS)
    edits = spark.createDataFrame([(4, 0, 3, "two"), (4, 0, 3, "zzz"), (4, 8, 99, None), (6, 5, 5, " new"), (1, 0, 0, "was null"), (77, 0, 1, "x"),
                                   (None, 0, 1, "x"), (8, None, 1, "x")], "doc_id long, begin int, end int, text string")
    got = {r.doc_id: r for r in T.recount(trees, edits, PATH, P.PATTERN).collect()}
    assert "".join(got[4].leaves) == "two two " and got[4].n_tokens == count("two two ") and got[4].n_edits == 2
    long = ROWS[8][1]
    assert got[6].n_tokens == count(long[:5] + " new" + long[5:]) and got[6].chars_encoded < 3 * T.LEAF
    assert got[1].n_tokens == count("was null") and got[1].n_before == 0
    assert got[8].n_edits == 0 and got[8].n_tokens == got[8].n_before and got[None].n_edits == 0
    assert T.recount(T.token_trees(empty(spark), PATH, P.PATTERN), edits, PATH, P.PATTERN).count() == 0
    assert T.recount(trees, edits.filter("false"), PATH, P.PATTERN).filter("n_tokens <> n_before").count() == 0


def test_all_edits_at_one_place(spark):
    docs = spark.createDataFrame([(1, ""), (2, "x"), (3, "one two three"), (4, "abcdefghij"), (5, "ab")], "doc_id long, text string")
    edits = [(1, 0, 0, "b", 1), (1, 0, 0, "z", 0), (1, 0, 10, None, 0), (2, 0, 0, "front ", 0), (2, 0, 10, None, 0), (2, 1, 1, " end", 1),
             (3, 3, 3, " and", 0), (3, 3, 3, " and", 0), (3, 3, 7, None, 0), (4, 0, 5, "X", 0), (4, 3, 8, "Y", 0), (4, 3, 4, "Z", 0), (4, 6, 6, "W", 0),
             (5, 9, 9, "2", 0), (5, 4, 4, "1", 0), (5, -3, 1, "0", 0), (5, 1, 30, None, 0)]
    trees = T.token_trees(docs, PATH, P.PATTERN)
    rows = T.recount(trees, spark.createDataFrame(edits, "doc_id long, begin int, end int, text string, seq int"), PATH, P.PATTERN).collect()
    want = {1: "zb", 2: "front  end", 3: "one and and three", 4: "XZYWij", 5: "012"}
    assert {r.doc_id: "".join(r.leaves) for r in rows} == want
    assert all(r.n_tokens == sum(map(count, r.leaves)) == count(want[r.doc_id]) and r.n_left_out == 0 for r in rows)
    assert {r.doc_id: r.n_edits for r in rows} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 4}


def test_the_query_applies_its_three_edits(spark):
    from quiremill.llm.queries import edits_of_documents
    texts = [None, "", "x", "twelve chars", "some words in a row " * 40]
    docs = spark.createDataFrame([(i, t, "src", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    for r in T.recount(T.token_trees(docs, PATH, P.PATTERN), edits_of_documents(docs), PATH, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        want = "src\n" + t[:len(t) // 2] + t[len(t) // 2 + 10:] + " en"
        assert "".join(r.leaves) == want and r.n_edits == 3 and r.n_tokens == count(want)
