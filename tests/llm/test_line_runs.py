import hashlib
import random
from collections import Counter, defaultdict

import pytest
from common_cases import ROWS, awkward, empty

from quiremill.llm import line_runs as L


def plain(rows, min_chars=40, min_docs=5):
    """The rule in plain Python: counter of (id, text, n_lines, n_dropped)."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-1 if i is None else i)
    frequent = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if frequent.get(key(x), -1 if i is None else i) == (-1 if i is None else i)]
        out[(i, "\n".join(stay), len(lines), len(lines) - len(stay))] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def notices(n=240, seed=3):
    rng = random.Random(seed)
    pool = [f"Notice {k}: this line is repeated in several converted documents" for k in range(60)]
    rows = []
    for i in range(n):
        lines = [rng.choice([str.upper, str, lambda s: f"  {s}\t\r"])(rng.choice(pool[:rng.choice([3, 60])])) for _ in range(rng.randrange(5))]
        lines += [f"A line of its own, number {i}, that no other document holds", "short", "é" * 39, "é" * 40, "É" * 40]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (7, 2)])
def test_rule(spark, batches, fanout):
    rows = notices()
    assert found(L.without_frequent_lines(table(spark, rows), batches=batches, fanout=fanout)) == plain(rows)


@pytest.mark.parametrize("hot", [0, 5])
def test_lines_beyond_the_bound_meet_in_a_join(spark, hot):
    rows = notices() + [(None, notices()[7][1]), (7, notices()[9][1])]
    assert found(L.without_frequent_lines(table(spark, rows), hot_lines=hot)) == plain(rows)


def test_the_answer_does_not_depend_on_the_layout(spark):
    rows = notices(100)
    assert found(L.without_frequent_lines(table(spark, rows, 1))) == found(L.without_frequent_lines(table(spark, rows, 13))) == plain(rows)


def test_awkward_documents(spark):
    assert found(L.without_frequent_lines(awkward(spark), min_docs=2)) == plain(ROWS, min_docs=2)
    assert found(L.without_frequent_lines(awkward(spark).select("doc_id", "text", "name"), 3, 2)) == plain(ROWS, 3, 2)


def test_repeated_and_null_ids(spark):
    line = "a line that stands in every one of these documents"
    rows = [(1, line)] * 3 + [(2, line + "\nx")] * 2 + [(None, line)] * 2
    assert found(L.without_frequent_lines(table(spark, rows))) == plain(rows) == Counter(
        {(1, "", 1, 1): 3, (2, line + "\nx", 2, 0): 2, (None, "", 1, 1): 2})
    nulls = [(None, line)] * 6
    assert found(L.without_frequent_lines(table(spark, nulls))) == Counter({(None, line, 1, 0): 6})


def test_a_line_in_a_third_of_all_documents(spark):
    line = "Converted from the original by the document service"
    rows = [(i, f"{line}\n{line}\nown {i}" if i % 3 == 0 else f"own {i}") for i in range(900)]
    got = found(L.without_frequent_lines(table(spark, rows)))
    assert got == plain(rows) and got[(897, f"{line}\n{line}\nown 897", 3, 0)] == 1


def test_ids_that_are_strings(spark):
    line = "a line that stands in every one of these documents"
    df = spark.createDataFrame([(f"doc-{i}", line) for i in range(6)], "doc_id string, text string")
    assert {r.doc_id: r.n_dropped for r in L.without_frequent_lines(df).collect()} == {f"doc-{i}": int(i < 5) for i in range(6)}


def test_runs_and_their_levels(spark):
    """Each hash is fresh in one run only; three runs of a level become one of the next."""
    store = L.LineRuns(spark, fanout=3)
    rows = notices(90)
    for lo in (75, 60, 45, 30, 15, 0):
        store.add(L.line_counts(table(spark, rows[lo:lo + 15])))
    assert [len(x) for x in store.levels] == [0, 2]
    fresh = Counter((r.h1, r.h2) for run in store.runs() for r in run.filter("fresh").collect())
    assert fresh and max(fresh.values()) == 1
    met = store.spark.table(store.levels[1][0]).join(store.spark.table(store.levels[1][1]).hint("merge"), L.HASH, "left_anti")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    store.frequent()


def test_empty(spark):
    assert L.without_frequent_lines(empty(spark)).count() == 0


def test_query_hash(spark):
    assert L.line_hash(b" " * 50) is None
    assert L.line_hash(b"  " + b"Ab" * 20 + b"\r") == hashlib.blake2b(b"ab" * 20, digest_size=16).digest()
