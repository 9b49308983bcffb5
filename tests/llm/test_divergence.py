import random
import re
from collections import Counter, defaultdict

import pytest
from common_cases import awkward, empty
from pyspark.sql import functions as F

from quiremill.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, min_docs=30, top=50):
    """The rule in plain Python over (text, lang, category)."""
    rows = [(t or "", a or "", c or "") for t, a, c in rows]
    docs, counts, cats = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, cat in rows:
        docs[lang].update(set(words(t)))
        counts[lang, cat].update(words(t))
        cats[lang].add(cat)
    out = set()
    for lang, some in cats.items():
        terms = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(terms)

        def share(c):
            total = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in terms}

        p = {cat: share(counts[lang, cat]) for cat in some}
        q = share(sum((counts[lang, cat] for cat in some), Counter()))
        for cat in some:
            pairs = [(sum(abs(p[cat][t] - p[o][t]) for t in terms), o) for o in some if o != cat]
            best = [(p[cat][t] - q[t], t) for t in terms if counts[lang, cat][t] and p[cat][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, top)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, cat, part, item, value, k))
    return out


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    pool = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Größe", "größe", "漢字", "ÉCOLE", "école", "x" * 300]
    rows = []
    for i in range(n):
        lang, cat = rng.choice(["ko", "ko", "en", None]), rng.choice(["document", "document", "image", "video", ""])
        some = rng.choices(pool, [1 / (1 + (j + len(cat) * 7) % 40) for j in range(len(pool))], k=rng.randrange(0, 60))
        rows.append((" 7-".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in some), lang, cat))
    return [*rows, (None, "ko", "lone"), ("never heard", "la", "document"), ("never heard", "la", "image"), (None, None, None)]


def found(df):
    assert df.columns == ["lang", "category", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, "text string, lang string, category string").repartition(parts)


def test_rule(spark):
    rows = corpus()
    want = plain(rows)
    assert {("la", "document", "pair", "image", 0, 1), ("la", "image", "pair", "document", 0, 1)} <= want
    assert found(D.category_divergence(table(spark, rows))) == want


def test_small_shards_blocks_and_tiles(spark, monkeypatch):
    """Several shards, a pass for each block, a term list and categories cut into tiles: the same answer."""
    monkeypatch.setattr(D, "TILE_TERMS", 3)
    monkeypatch.setattr(D, "TILE_GROUPS", 2)
    rows = corpus(250, 9)
    got = D.category_divergence(table(spark, rows, 3), min_docs=10, top_terms=4, shard_terms=16, block_terms=40)
    assert found(got) == plain(rows, 10, 4)


@pytest.mark.parametrize("of", [D.hash_of, lambda t: len(t), lambda t: 7])
def test_perfect_hash(of):
    """Every term has a slot of its own below n, also where hashes are equal; other terms have none."""
    import numpy as np
    terms = [f"t{i}".encode() for i in range(3000)]
    table = D.PerfectHash(*D.PerfectHash.build(terms, of))
    of_all = lambda ts: np.fromiter(map(of, ts), np.uint64, len(ts))
    slots = table.slots(terms, of_all(terms)).tolist()
    assert sorted(slots) == list(range(len(terms))) and [table.term(s) for s in slots] == terms
    others = [f"u{i}".encode() for i in range(3000)]
    assert set(table.slots(others, of_all(others)).tolist()) == {-1}


def test_perfect_hash_is_small():
    sizes, *_ = D.PerfectHash.build([f"term {i}".encode() for i in range(20_000)])
    assert sum(sizes) < 4 * 20_000


def test_the_sharding_is_that_of_spark(spark):
    terms = ["a", "größe", "漢字", "x" * 999]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(7)).alias("s")).collect()
    import numpy as np
    assert [r.s for r in rows] == [int(np.uint64(D.hash_of(r.t.encode())).view(np.int64) % 7) for r in rows]


def test_terms():
    text = "AbC1d_e\u00c9\u00e9 \u212a\x00z\u6f22\u5b57,"
    assert D.terms_of(text.encode()) == [w.encode() for w in words(text)] == [w.encode() for w in ("abc", "d", "e\u00c9\u00e9", "\u212a", "z\u6f22\u5b57")]


def test_a_category_with_most_rows(spark):
    rows = [(f"common text {'odd' if i % 7 else 'even'} page", "ko", "document" if i % 3 else f"c{i % 4}") for i in range(900)]
    assert found(D.category_divergence(table(spark, rows))) == plain(rows)


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 9_100_000_000_000, 3)], "n long, total long, v long")
    assert df.select(D._share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * 9_000_000_000_005 // 9_100_000_000_015


def test_awkward_documents(spark):
    df = awkward(spark).withColumn("lang", F.lit("ko")).withColumn("category", F.when(F.col("doc_id") % 2 == 0, "a")).withColumn("term", F.lit("t"))
    rows = [tuple(r) for r in df.select("text", "lang", "category").collect()]
    assert found(D.category_divergence(df, min_docs=1)) == plain(rows, 1)


def test_empty(spark):
    df = empty(spark).withColumns({"lang": F.lit("ko"), "category": F.lit("a")})
    assert D.category_divergence(df).collect() == []
