import random

import public_tokenizers as P
import sentencepiece

from kipimo.llm import token_count

MODEL = P.path("piece_bpe_32k.model")
ALPHABET = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "日", "ﬁ", "<s>", "</s>", "<unk>", "😀", "ing", "'", "0", "́", "\x00", "\xa0"]


def test_equals_library(spark, table_of):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += [None, "", " ", "ab" * 3000, "a " * 5000, "a " * 5000]
    docs = table_of([(i, t) for i, t in enumerate(texts)] + [(0, "again"), (None, "no id")], ["n_bytes"])
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = token_count.count_tokens(docs, MODEL).collect()
    expected = []
    for r in docs.collect():
        text = r.text or ""
        n = len(library.encode(text))
        expected.append((str(r.doc_id), len(text.encode()), n, n > 4096))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted(expected)


def test_empty_table(spark, table_of):
    assert token_count.count_tokens(table_of([]), MODEL).collect() == []


def test_table_of_segments_stays_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "KEPT", 3)
    counter = token_count.PieceCounter(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "one two three four five six one two"
    assert counter.count(text) == len(library.encode(text)) and len(counter.kept) <= 3
