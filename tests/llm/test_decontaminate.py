import math
import random

import pytest
from common_cases import awkward, empty

from quiremill.llm import decontaminate as D


def distance(item, text):
    """Least edit distance of the whole item to any stretch of the text, in plain words."""
    before = list(range(len(item) + 1))
    best = before[-1]
    for w in text:
        row = [0]
        for i, x in enumerate(item, 1):
            row.append(min(before[i - 1] + (x != w), before[i] + 1, row[i - 1] + 1))
        before = row
        best = min(best, row[-1])
    return best


def test_nearest_against_the_plain_distance():
    rnd = random.Random(2)
    for _ in range(300):
        item, text = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 12))], [rnd.randint(0, 5) for _ in range(rnd.randint(0, 20))]
        limit, d = rnd.randint(0, 4), distance(item, text)
        got = D.nearest(item, text, limit)
        assert (got[0] if got else None) == (d if d <= limit else None) or (got is None and d == len(item) <= limit)


def test_recall_on_edited_passages():
    """Items edited up to the limit, hidden among other words: the target recall against the exact distance."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 9, 12, 20, 40, 60])))) for i in range(300)]
    index = D.ItemIndex(items, 0.8, D.n_functions(0.8, 0.99)).ready()
    texts = []
    for _, t in items:
        w = t.split()
        for _ in range(int(0.2 * len(w) + 1e-9)):
            j, kind = rnd.randrange(len(w)), rnd.random()
            w[j:j + 1] = [rnd.choice(vocabulary)] if kind < 0.4 else [] if kind < 0.7 else [w[j], rnd.choice(vocabulary)]
        texts.append(" ".join([rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))] + w + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]))
    got = {(a, b): d for a, b, d, _, _ in index.matches(texts)}
    total = there = 0
    for k, (_, item) in enumerate(items):
        d = distance(D.words_of(item), D.words_of(texts[k]))
        if d <= index.limit[k]:
            total += 1
            if (k, k) in got:
                there += 1
                assert got[(k, k)] >= d
    assert total > 250 and there >= 0.99 * total
    for (a, b), d in got.items():
        assert d <= index.limit[b] and distance(D.words_of(items[b][1]), D.words_of(texts[a])) <= d


def test_whole_documents_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: D.words_of(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        w = D.words_of(r.text)
        for i, item in items.items():
            if len(set(item) & set(w)) * 2 > len(set(item)) and distance(item, w) <= int(0.2 * len(item)):
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == want and want
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == want


def leak():
    """An item of 60 words and a document that holds its words 10 to 59."""
    words = [f"word{i}" for i in range(60)]
    return " ".join(words), " ".join(words[10:])


@pytest.mark.parametrize("before", [[], [""], [None], ["two words"], ["", ""], ["a few words more", "", "x"], ["w " * 9], ["w " * 30]])
def test_an_item_without_its_first_words_behind_other_texts(before):
    item, text = leak()
    index = D.ItemIndex([(1, item)], 0.8, D.n_functions(0.8, 0.99)).ready()
    for after in ([], [""], ["some more"]):
        got = index.matches([t or "" for t in [*before, text, *after]])
        assert got == [(len(before), 0, 10, 0, 50)]


def test_items_at_the_borders_of_texts():
    """Items cut at either end by as many words as the limit allows, each between empty, short and long texts."""
    rnd = random.Random(9)
    items = [(i, " ".join(f"v{rnd.randrange(2000)}" for _ in range(rnd.choice([5, 10, 25, 60, 100])))) for i in range(120)]
    index = D.ItemIndex(items, 0.8, D.n_functions(0.8, 0.99)).ready()
    texts, want = [], set()
    for i, t in items:
        w = t.split()
        cut = int(0.2 * len(w) + 1e-9)
        k = rnd.randint(0, cut)
        texts += rnd.choice([[], [""], ["", "a b"], ["q " * 40]])
        want.add((len(texts), i))
        texts.append(" ".join(w[k:len(w) - cut + k]))
    got = {(a, b) for a, b, *_ in index.matches(texts)}
    assert len(want - got) <= 1 and got >= {(a, b) for a, b in want if len(items[b][1].split()) >= 25}


def test_the_answer_does_not_depend_on_the_layout(spark):
    item, text = leak()
    bench = spark.createDataFrame([(1, item), (2, "five words that are here")], "item_id long, text string")
    rows = [(i, t) for i, t in enumerate([None, "short", text, "", "x " * 50, text, "five words that were here", None, text])]
    want = [(2, 1), (5, 1), (6, 2), (8, 1)]
    for parts in (1, 4, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1) if parts == 1 else spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()) == want
        assert sorted(r.doc_id for r in D.without_contaminated(docs, bench).collect()) == [0, 1, 3, 4, 7]


def test_rows_are_judged_by_their_own_text(spark, monkeypatch):
    item, text = leak()
    bench = spark.createDataFrame([(1, item), (2, "five words that are here")], "item_id long, text string")
    rows = [(None, text, 1), (None, "clean", 2), (4, text, 3), (4, "clean too", 4), (4, "five words that are here", 5), (None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int").repartition(3)
    for size in (D.BLOCK_BYTES, 1):  # the second: a block for each item
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = D.without_contaminated(docs, bench)
        assert got.columns == docs.columns and sorted(r.item_id for r in got.collect()) == [2, 4, 6]
    assert D.without_contaminated(empty(spark), bench).count() == 0
    assert D.without_contaminated(docs, bench.filter("false")).count() == 6


def test_samples_over_the_whole_window_take_many_more_functions():
    """Why the samples come from the first steps of the walk."""
    needed = math.log(0.01) / math.log(1 - D.agreement(50, 0.8, 4, 600))
    assert needed > 5 * D.n_functions(0.8, 0.99)


def test_awkward_tables(spark):
    bench = spark.createDataFrame([(1, "One two, three!"), (2, None), (3, ""), (None, "one two three"), (1, "*** lorem ipsum"), (5, "x" * 50_000)],
                                  "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.distance) for r in D.contaminated(awkward(spark), bench).collect())
    threes = [(4, 0, 0), (4, 1, 0), (4, 0, 0), (4, 1, 0), (5, 0, 0), (5, 1, 0), (0, 0, 0), (0, 1, 0)]
    assert got == sorted(threes + [(6, 1, 0), (7, 1, 0), (9, 5, 0)])
    assert D.contaminated(empty(spark), bench).count() == 0
    assert D.contaminated(awkward(spark), bench.filter("false")).count() == 0


@pytest.mark.parametrize("text,words", [("A, b-c! (D)", ["a", "b-c", "d"]), ("*** | __ x", ["x"]), ("", [])])
def test_words(text, words):
    assert D.words_of(text) == words
