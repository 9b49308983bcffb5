from collections import Counter

import pytest
from common_cases import ROWS, awkward, empty, files_of

from quiremill.llm import sharding as S


def test_table_is_filled_in_turns():
    table = S.lookup_table([f"s{i}" for i in range(7)], 101)
    counts = Counter(table)
    assert len(table) == 101 and set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1


def test_against_the_rule_in_plain_words():
    import hashlib
    names, slots = ["b", "a", "c"], 13
    prefer = []
    for n in names:
        h = hashlib.sha256(n.encode()).digest()
        start, step = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        prefer.append([(start + k * step) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for s, order in enumerate(prefer):
            free = [x for x in order if x not in owner]
            if free:
                owner[free[0]] = s
    assert S.lookup_table(names, slots) == [owner[i] for i in range(slots)]


def test_few_rows_move_when_a_shard_goes():
    names = [f"s{i}" for i in range(20)]
    before, after = S.lookup_table(names), S.lookup_table(names[:-1])
    moved = sum(names[a] != names[b] for a, b in zip(before, after) if names[a] != names[-1])
    assert moved < 0.1 * len(before)


@pytest.mark.parametrize("bad", [([], 13), (["a", "a"], 13), (["a"], 12), (["a"] * 0 + [str(i) for i in range(20)], 13)])
def test_bad_tables(bad):
    with pytest.raises(ValueError):
        S.lookup_table(*bad)


def test_awkward_files(spark):
    got = S.place(files_of(awkward(spark)), ["x", "y", "z"])
    rows = got.collect()
    assert got.columns == ["file_id", "slot", "shard"] and Counter(r.file_id for r in rows) == Counter(i for i, _ in ROWS)
    assert len({(r.file_id, r.slot, r.shard) for r in rows}) == len({i for i, _ in ROWS})
    table = S.lookup_table(["x", "y", "z"])
    assert all("xyz"[table[r.slot]] == r.shard for r in rows)
    assert S.place(files_of(empty(spark)), ["x"]).count() == 0


def test_no_shuffle_and_no_python(spark):
    plan = S.place(files_of(awkward(spark)).coalesce(1), ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "SortMergeJoin" not in plan
