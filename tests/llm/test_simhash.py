import random

import numpy as np
import pytest
import xxhash
from common_cases import awkward, empty

from quiremill.llm import simhash as S


def signed(v):
    return int(np.uint64(v).view(np.int64))


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(values, bits=3):
    xs = sorted(set(values))
    arr, root = np.array(xs, np.uint64), list(range(len(xs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(xs)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {x: xs[find(i)] for i, x in enumerate(xs)}


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fp = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    comp, least = plain_components(fp.values()), {}
    for d, f in fp.items():
        least[comp[f]] = min(d, least.get(comp[f], d))
    got = S.near_duplicates(docs).select("doc_id", S.hex_of("fingerprint").alias("h"), "component_id").collect()
    assert {r.doc_id: (r.h, r.component_id) for r in got} == {d: (f"{f:016x}", least[comp[f]]) for d, f in fp.items()}


@pytest.mark.parametrize("node,blocks", [(1024, None), (40, None), (1024, 5), (40, 6)])
def test_links_of_clusters_in_hot_blocks(spark, node, blocks):
    rnd = random.Random(3)
    xs = {0, 1, (1 << 64) - 1, (1 << 64) - 8} | {rnd.getrandbits(64) for _ in range(200)}
    for b in list(xs)[:20]:
        for _ in range(40):
            xs.add(b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 4))))
    centre = rnd.getrandbits(64)
    for _ in range(1200):  # one block value for all
        xs.add(centre ^ sum(1 << k for k in rnd.sample(range(48), rnd.randint(1, 6))))
    df = spark.createDataFrame([(signed(x),) for x in xs] + [(None,)], "fp long").repartition(4)
    root = {r.node: r.root for r in S.components(S.links(df, 3, node, blocks)).collect()}
    groups = {}
    for x, c in plain_components(xs).items():
        groups.setdefault(c, []).append(signed(x))
    assert {v: root.get(v, v) for g in groups.values() for v in g} == {v: min(g) for g in groups.values() for v in g}


def test_more_blocks_compare_fewer_nodes(spark):
    """100 nodes share a value of a 16-bit block; with six blocks their copies part, and the links are the same."""
    rnd = random.Random(4)
    xs = {0xABCD << 48 | rnd.getrandbits(48) for _ in range(4000)}
    xs |= {x ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 3))) for x in list(xs)[:400]}
    df = spark.createDataFrame([(signed(x),) for x in xs], "fp long").repartition(3)
    want = plain_components(xs)
    compared = {}
    for blocks in (4, 6):
        compared[blocks] = sum(len(v) ** 2 for v in _by_front(xs, blocks).values())
        root = {r.node: r.root for r in S.components(S.links(df, 3, 40, blocks)).collect()}
        groups = {}
        for x, c in want.items():
            groups.setdefault(c, []).append(signed(x))
        assert {v: root.get(v, v) for g in groups.values() for v in g} == {v: min(g) for g in groups.values() for v in g}
    assert compared[6] * 10 < compared[4]


def _by_front(xs, blocks):
    """Fingerprints by the value in front, for every choice of blocks."""
    out = {}
    arr = np.array(sorted(xs), np.uint64)
    for c in S._choices(blocks, 3):
        spans = S._spans(c, blocks)[:len(c)]
        for x in arr.tolist():
            out.setdefault((c, tuple(x >> low & (1 << w) - 1 for low, w in spans)), []).append(x)
    return out


def test_blocks_by_size():
    assert [S.n_blocks(n) for n in (0, 10**6, 4 * 10**6, 10**8, 10**9, 10**10, 10**11)] == [4, 4, 4, 5, 5, 6, 6]
    for n in (10**6, 10**8, 10**10):
        b = S.n_blocks(n)
        assert n >> S.front_bits(S._choices(b, 3)[0], b) <= 300


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_bits_come_back_to_their_place(spark, blocks):
    from pyspark.sql import functions as F
    xs = np.array([random.Random(7).getrandbits(64) for _ in range(20)] + [0, 2**64 - 1], np.uint64)
    df = spark.createDataFrame([(signed(x),) for x in xs.tolist()], "fp long")
    for c in S._choices(blocks, 3):
        moved = np.array([r[0] for r in df.select(S.in_front(F.col("fp"), c, blocks)).collect()], np.int64).view(np.uint64)
        assert (S.in_place(moved, c, blocks) == xs).all() and (np.bitwise_count(moved ^ moved[0]) == np.bitwise_count(xs ^ xs[0])).all()


def test_one_row_of_each_group_stays(spark):
    """Null ids come last, rows that share an id are judged by their own texts, repeated rows are one."""
    near = "some words that stand in both of these documents " * 30
    rows = [(None, near, 1), (5, near, 2), (5, "quite another text with words of its own " * 9, 3), (3, near + "more", 4), (None, "alone " * 40, 5),
            (None, "alone " * 40, 6), (7, None, 7), (None, "", 8), (5, near, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    left = S.without_near_duplicates(df)
    fp = {r[2]: plain_fingerprint(r[1]) for r in rows}
    comp, best = plain_components(fp.values()), {}
    for i, t, n in rows:
        key = (i is None, i or 0, t or "")
        best[comp[fp[n]]] = min(best.get(comp[fp[n]], key), key)
    got = [(r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect()]
    assert left.columns == df.columns and sorted(got) == sorted(best.values()) and len(best) >= 3


def test_gray_neighbours_differ_in_one_bit():
    rank = S.gray_rank(np.arange(256, dtype=np.uint64))
    order = np.argsort(rank)
    assert all(bin(int(a) ^ int(b)).count("1") == 1 for a, b in zip(order, order[1:]))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5001), (5001, 5000)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(400)}, 5000: 5000, 5001: 5000}


def test_awkward_documents(spark):
    rows = S.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 12
    blank = [r for r in rows if r.fingerprint == 0]
    assert {r.doc_id for r in blank} == {1, 2, 3, None} and {r.component_id for r in blank} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4} and {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert S.near_duplicates(empty(spark)).count() == 0
