import hashlib
import random

import public_tokenizers as P
import pytest

from kipimo.llm import byte_bpe

RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
ALPHABET = ["a", "Zb", " ", "  ", "\n", "\n\n", "'s", "'ll", "é", "日本", "。", "12", "!!", "😀", "\t", "\x1c", "\xa0", "x" * 70]


def _texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 160))) for _ in range(60)]
    return texts + ["a" * 500, " " * 300, "\n" * 200 + "x", "ab cd " * 80, None, "", "ab cd " * 80]


@pytest.mark.parametrize("chunk,overlap", [(32, 8), (64, 64), (40, 1)])
def test_equals_whole_text_encoding(spark, table_of, chunk, overlap):
    texts = _texts()
    docs = table_of([(i, t) for i, t in enumerate(texts)] + [(64, texts[63]), (None, texts[63]), (None, None)], ["ids"])
    found = byte_bpe.encode_texts(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap)
    rows = byte_bpe.decode_ids(found, RANKS, PATTERN).collect()
    whole = byte_bpe.encoding(RANKS, PATTERN)
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(i), whole.encode_ordinary(t)) for i, t in given)
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in rows) == sorted((str(i), t.encode()) for i, t in given)


def test_digests(spark, table_of):
    docs = table_of([(1, "the cat"), (2, None)])
    got = {
        r.doc_id: r
        for r in byte_bpe.digests(
            byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, PATTERN), RANKS, PATTERN)
        ).collect()
    }
    ids = byte_bpe.encoding(RANKS, PATTERN).encode_ordinary("the cat")
    assert got[1].n_tokens == len(ids)
    assert got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"the cat").hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark, table_of):
    encoded = byte_bpe.encode_texts(table_of([]), RANKS, PATTERN)
    assert byte_bpe.digests(byte_bpe.decode_ids(encoded, RANKS, PATTERN)).collect() == []


def test_bad_overlap(spark, table_of):
    with pytest.raises(ValueError):
        byte_bpe.encode_texts(table_of([]), RANKS, PATTERN, chunk=8, overlap=9)


def test_decoded_by_the_worker_that_encoded(spark, table_of):
    texts = _texts()
    docs = table_of([(i, t) for i, t in enumerate(texts)] + [(64, texts[63]), (None, None)])
    rows = byte_bpe.encode_texts(docs, RANKS, PATTERN, chunk=32, overlap=8, with_bytes=True).collect()
    whole = byte_bpe.encoding(RANKS, PATTERN)
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(i), whole.encode_ordinary(t)) for i, t in given)
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in rows) == sorted((str(i), t.encode()) for i, t in given)
