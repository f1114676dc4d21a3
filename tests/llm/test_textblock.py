"""Keys of words against the plain sum over their bytes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kipimo.llm import textblock


@pytest.mark.parametrize("summed", [textblock._SUMMED, 3])
def test_running_sums_give_the_plain_keys(monkeypatch, summed):
    monkeypatch.setattr(textblock, "_SUMMED", summed)
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab é.\n", k=rng.randint(0, 300))) for _ in range(40)] + ["x" * 5000, "", " "]
    block = textblock.TextBlock.of(pa.array(texts))
    words = [w for t in texts for w in t.encode().split()]
    plain = [sum(int(textblock._BYTE[b]) * pow(textblock._STEP, i, 1 << 64) for i, b in enumerate(w)) + len(w) * int(textblock._M2) for w in words]
    expected = textblock.mixed(np.array([v % (1 << 64) for v in plain], np.uint64))
    assert block.hashes().tolist() == expected.tolist()


def test_tables_stay_small(monkeypatch):
    """Texts above the limit leave no tables of their length behind."""
    monkeypatch.setattr(textblock, "_SUMMED", 1000)
    monkeypatch.setattr(textblock, "_tables", [np.ones(1, np.uint64)] * 2)
    for n in (10, 900, 50_000):
        textblock.TextBlock.of(pa.array(["a " * n])).hashes()
    assert len(textblock._tables[0]) <= 1001
