import random

import pytest

from kipimo.llm import substring


def _expected(rows, span):
    """Brute force over (doc_id, words); None is the smallest id."""
    key = lambda i: (-1, 0) if i is None else (0, i)
    first = {}
    for i, words in rows:
        for p in range(len(words) - span + 1):
            w = tuple(words[p : p + span])
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, words in rows:
        gone = set()
        for p in range(len(words) - span + 1):
            if first[tuple(words[p : p + span])] < key(i):
                gone.update(range(p, p + span))
        out.append((str(i), len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(out)


def _rows(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))] for _ in range(12)]
    rows = []
    for i in range(90):
        words = []
        for _ in range(rng.randint(0, 4)):
            source = rng.choice(base)
            at = rng.randint(0, len(source))
            words += source[at : at + rng.randint(1, 40)]
            if rng.random() < 0.3:
                words += [f"u{rng.randint(0, 9)}"]
        rows.append((rng.randint(0, 70), words))
    return rows + [(None, base[1]), (None, base[2]), (99, base[1] + base[2]), (99, base[1]), (99, base[1])]


@pytest.mark.parametrize("seed,span,gram,local", [(1, 5, 3, 10**6), (2, 5, 5, 20), (3, 13, 4, 50), (4, 2, 1, 0), (5, 6, 2, 10**6)])
def test_equals_brute_force(spark, table_of, seed, span, gram, local):
    rows = _rows(seed)
    texts = [(i, "\t ".join(w) if k % 5 else " " + "\n".join(w)) for k, (i, w) in enumerate(rows)]
    docs = table_of(texts + [(200, None), (201, "")], ["kept", "row", "id"]).repartition(3)
    found = substring.remove_repeats(docs, span=span, gram=gram, local_words=local).collect()
    expected = _expected(rows + [(200, []), (201, [])], span)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == expected


def test_many_copies(spark, table_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text if i % 3 else f"x{i} {text} y{i}") for i in range(600)]
    found = substring.remove_repeats(table_of(rows)).collect()
    assert len(found) == 600
    assert all(r.n_removed == (0 if r.doc_id == 0 else 40) for r in found)


def test_empty_table(spark, table_of):
    assert substring.remove_repeats(table_of([])).collect() == []
