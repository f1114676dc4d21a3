import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from kipimo.llm import token_files

FILE = P.path("word_bpe_49k.json")
ALPHABET = ["a", "The", " ", "  ", "\n", "\t", "É", "日本", "ﬁ", "<|endoftext|>", "😀", "ing's", "'", "ab.", "É,!", "».", "09", "́", "\x1c", "\xa0", "\x85", " ", "Σ"]


def _round(values):
    words, firsts = token_files.pack(values)
    return words, token_files.unpack(words, firsts, len(values)).tolist()


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    cases = [[], [0], [1], [2**64 - 1], [2**60 - 1, 2**60, 5, 2**63, 2**63], [0] * 5000, [2**64 - 1] * 1025]
    for bits in (1, 3, 8, 11, 16, 33, 60, 64):
        n = int(rng.integers(1, 4000))
        cases.append([int(x) >> (64 - bits) for x in rng.integers(0, 2**64, n, dtype=np.uint64)])
    mixed = [int(x) >> int(s) for x, s in zip(rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 64, 5000))]
    for values in [*cases, mixed]:
        assert _round(np.array(values, np.uint64))[1] == values


def test_narrow_values_share_words():
    words, _ = _round(np.ones(600, np.uint64))
    assert len(words) == 10
    assert len(_round(np.full(1024, 49_000, np.uint64))[0]) == 342


def test_files_equal_library(spark, table_of, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 50)
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "word " * 3000, "ab" * 2000]
    rows = [(i * 3 % 304, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again")]
    docs = table_of(rows, ["start", "ids"])
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, FILE, 2)
    found = token_files.file_checksums(spark, path).orderBy("doc_id", "start").collect()
    read = token_files.read_token_files(spark, path).orderBy("doc_id", "start").collect()
    library = Tokenizer.from_file(FILE)
    start = 0
    given = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert [r.doc_id for r in found] == [d for d, _ in given]
    for row, other, (_, text) in zip(found, read, given):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert (other.start, other.ids) == (start, ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_null_id_and_empty_table(spark, table_of, tmp_path):
    token_files.write_token_files(table_of([(None, "x"), (1, None)]), str(tmp_path / "a"), FILE, 2)
    rows = token_files.read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (1, 2)]
    token_files.write_token_files(table_of([]), str(tmp_path / "b"), FILE, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "b")).collect() == []
    assert token_files.file_checksums(spark, str(tmp_path / "b")).collect() == []


def test_bounded_table(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 2)
    encoder = token_files.WordEncoder(FILE)
    library = Tokenizer.from_file(FILE)
    for text in ("one two three one", "one", "four five", "one two", "One. two,", "é. »."):
        assert encoder.ids(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_letter_before_every_stop():
    """Letters whose normal form ends in a mark join the stops behind them."""
    library, own = Tokenizer.from_file(FILE), token_files.WordEncoder(FILE)
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    words = [f"a{c}{'.,;:!?'[i % 6]}" for i, c in enumerate(letters)]
    special = [c for c in letters if c > "\x7f" and not own._stays_letter(c)]
    assert "\u0130" in special and len(special) < 200
    words += [c + stops for c in special for stops in (*".,;:!?", "...", "?!")] + ["Merhaba", "\u0130!", "tamam"]
    expected = [i for e in library.encode_batch_fast(words, add_special_tokens=False) for i in e.ids]
    assert own.ids(" ".join(words).encode()).tolist() == expected


def test_one_thread_a_task():
    """The tokenizer starts no threads beside the task's own."""
    program = (
        "import os; from kipimo.llm.token_files import WordEncoder\n"
        f"encoder = WordEncoder({FILE!r}); before = len(os.listdir('/proc/self/task'))\n"
        "encoder.ids(b' '.join(b'w%dx' % i for i in range(2000)))\n"
        "print(len(os.listdir('/proc/self/task')) - before)"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith(("TOKENIZERS_", "RAYON_"))}
    root = Path(token_files.__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", program], env=env, cwd=root, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["0"]


def test_rare_words_by_the_model(monkeypatch):
    """Words of plain letters never go through the library's normaliser and splitter."""
    library, own = Tokenizer.from_file(FILE), token_files.WordEncoder(FILE)
    assert own.direct
    rng = random.Random(7)
    letters = token_files._LETTERS + token_files._LETTERS.upper() + "aeinrst" * 4
    plain = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) + rng.choice(["", ".", "?!"]) for _ in range(3000)]
    plain += ["ẞ", "K", "Ån", "\xffx", "ŸX.", "don", "\xb5"]
    odd = ["don't", "x́", "a1", "'s", "İ.", "İx", "ét\xe9", "\xaaa", "ΣΣ", "<|endoftext|>"]
    text = " ".join(plain + odd)
    assert own.ids(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
    asked = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    own.tokenizer = Counting()
    own.kept.clear()
    own.kept.rare.clear()
    own.ids(b"rarelysaid Rarelysaid, \xc3\x89trangement. x9")
    assert sorted(asked) == [",", ".", "x9"]
