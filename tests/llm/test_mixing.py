import hashlib
import math
import re
from collections import defaultdict

import duckdb
import pytest

from kipimo.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(sizes, weights=(1, 2, 3), most=3):
    """Words by source, by sharing the excess again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and weight[s] * left > most * sizes[s] * share}
        if not above:
            return {s: float(most * sizes[s]) if s in full else weight[s] * left / share for s in names}
        full |= above


def _mixed(rows):
    """taken of each row, by plain loops."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by = defaultdict(list)
    for i, (_, _, source) in enumerate(rows):
        by[source].append(i)
    total = {s: sum(size[i] for i in at) for s, at in by.items()}
    target, taken = _targets(total), [0] * len(rows)
    for s, at in by.items():
        copies = min(3, math.floor(target[s] / total[s])) if total[s] else 0
        rest = target[s] - copies * total[s]
        p, left = (rest / total[s] if total[s] else 0.0), math.floor(max(rest, 0.0))
        rank = {}
        for i in at:
            raw = f"mix:{'' if rows[i][0] is None else rows[i][0]}:{rows[i][1] or ''}"
            u = (int(hashlib.md5(raw.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            q = (u / (1 - u)) / (p / (1 - p)) if p > 0 else None
            rank[i] = None if q is None else math.floor(q / (1 + q) * 2**52)
        extra = set()
        for _ in range(mixing.FILLS):
            fits = defaultdict(list)
            for i in at:
                if i not in extra and rank[i] is not None and 0 < size[i] <= left:
                    fits[rank[i]].append(i)
            room = left
            for r in sorted(fits):
                words = sum(size[i] for i in fits[r])
                if words > room:
                    break
                room -= words
                extra |= set(fits[r])
            left = room
        groups = defaultdict(list)
        for i in at:
            if i not in extra and rank[i] is not None and 0 < size[i] < 2 * left:
                groups[rank[i], size[i]].append(i)
        near = [(abs(n * len(g) - left), r, n) for (r, n), g in groups.items() if abs(n * len(g) - left) < left]
        if near:
            _, r, n = min(near)
            extra |= set(groups[r, n])
        for i in at:
            taken[i] = (copies + (i in extra)) * size[i]
    return size, total, target, taken


def _check(found, rows):
    size, total, target, taken = _mixed(rows)
    expected = sorted(
        (str(rows[i][0]), size[i], total[rows[i][2]], target[rows[i][2]], taken[i]) for i in range(len(rows))
    )
    assert sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in found) == expected


def test_equal_to_plain_loops(spark, table_of):
    rows = []
    for i in range(400):
        source = ["hot", "b", "é", "", None, "tiny", "z"][0 if i % 3 == 0 else i % 7]
        rows.append((i, " ".join(["w"] * (1 + i * i % 97)), source))
    rows += [(0, rows[0][1], "hot")] * 3  # equal rows
    rows += [(900, None, "b"), (901, "", "b"), (902, " \n\t", "nothing"), (None, "a b c", "b"), (None, "a b", None)]
    rows += [(903, "x " * 5000, "b"), (904, "\u3000 one\u00a0two \x1c", "z"), (905, "only", "single")]
    docs = table_of([(i, t, None, s) for i, t, s in rows], ["size", "weight", "target", "_rank"])
    found = mixing.mix_sources(docs).collect()
    _check(found, rows)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))


def test_taken_words_come_near_their_targets(spark, table_of):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 300)), None, "abcd"[i % 4]) for i in range(3000)]
    sums = defaultdict(int)
    found = mixing.mix_sources(table_of(rows)).collect()
    for r in found:
        sums[r.source] += r.taken
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert all(abs(sums[r.source] - r.target) <= 2 for r in found)
    assert len({r.target for r in found}) == 3  # weights 1, 2, 3, 1


def test_targets_stop_at_three_times_a_source(spark, table_of):
    rows = [(0, "a b", None, "a"), (1, "a " * 1000, None, "b"), (2, "c", None, "c"), (3, "d " * 10, None, "d")]
    found = {r.source: (r.target, r.taken) for r in mixing.mix_sources(table_of(rows)).collect()}
    assert found["a"] == (6.0, 6) and found["c"] == (3.0, 3) and found["d"] == (30.0, 30)
    assert found["b"] == (1013.0 - 39.0, 1000)


def test_inclusion_follows_the_target(spark, table_of):
    """Over many seeds a document's extra copy is as frequent as its source's p."""
    docs = table_of([(i, "w w", None, "ab"[i % 2]) for i in range(60)])
    hits = defaultdict(int)
    for seed in range(6):
        for r in mixing.mix_sources(docs, seed=str(seed)).collect():
            hits[r.source] += r.copies
            assert r.target == {"a": 40.0, "b": 80.0}[r.source]
    assert hits == {"a": 6 * 20, "b": 6 * 40}


def test_many_sources_are_numbered_by_code_point(spark, table_of):
    names = [f"s{i:03}" for i in range(200)] + ["Z", "\U0001f600", "\uffee", None]
    docs = table_of([(i, "w", None, s) for i, s in enumerate(names)])
    order = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    found = {r.source: r.weight for r in mixing.mix_sources(docs).collect()}
    assert [found[s] for s in order] == [1 + i % 3 for i in range(len(order))]


def test_nothing_to_mix(spark, table_of):
    assert mixing.mix_sources(table_of([])).collect() == []
    found = mixing.mix_sources(table_of([(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2


def test_main_path_is_native(spark, table_of):
    plan = mixing.mix_sources(table_of([(1, "a b", None, "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    result = con.execute(mixing.SQL.format(documents="documents"))
    names = [c[0] for c in result.description]
    found = mixing.mix_sources(spark.read.parquet(path)).collect()
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(result.fetchall())
