import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest

from kipimo.llm import alignment

BYTES, PIECES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")

ODD = [
    None, "", " ", "  two  spaces ", "a", "naïve café — 東京 😀 ﬁ", "x\u2581y", "\u2581", "<|endoftext|> <s></s> <0x41>",
    "tab\tline\r\n\x00\x01", "it's they'll 12345 !!! ...", "a" * 3000, "é" * 700, " \u3000 ", "The quick brown fox. " * 40,
]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(BYTES, PIECES)


def _groups(tokenizers, text):
    """A and B tokens as (id, start, end) and their groups, by plain loops over bytes."""
    if not text:
        return [], [], []
    letters = alignment.byte_of_letter()
    a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
    b = tokenizers.b.encode(text)

    def spelled_a(i):
        return bytes(letters[c] for c in tokenizers.a.id_to_token(i))

    def spelled_b(i):
        p = tokenizers.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tokenizers.b.is_byte(i) else p.replace("\u2581", " ").encode()

    sides = []
    for ids, spelled in ((a, spelled_a), (b, spelled_b)):
        if b"".join(map(spelled, ids)) != (" " + text).encode():
            return [], [], []
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(spelled(i))))
            at += len(spelled(i))
        sides.append(side)
    a, b = sides
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, start = [], 0
    for cut in cuts:
        groups.append(([i for i, s, e in a if start <= s < cut], [i for i, s, e in b if start <= s < cut]))
        start = cut
    return a, b, groups


def _brute(tokenizers, rows):
    per, count = [], Counter()
    for doc_id, text in rows:
        a, b, groups = _groups(tokenizers, text)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        count.update(links)
        per.append((doc_id, a, b, groups, links))
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, a, b, groups, links in per:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                str(doc_id), len(a), len(b), len(groups), len(links),
                sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(out)


def _rows(df):
    return sorted(
        (str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()
    )


@pytest.mark.parametrize("lane", [1, 2, 64])
def test_gallop_equals_binary_search(lane):
    rng = np.random.default_rng(lane)
    for n, m in [(1, 1), (5, 400), (300, 301), (64, 5000), (1000, 20)]:
        long = np.unique(rng.integers(0, 10 * m, m))
        short = np.unique(np.append(rng.integers(0, long[-1] + 1, n), long[-1]))
        assert (alignment.gallop(short, long, lane) == np.searchsorted(long, short)).all()


def test_packed_links():
    for keys in ([], [0], [5, 5, 5 << 40], sorted(np.random.default_rng(0).integers(0, 1 << 47, 999))):
        keys = np.array(keys, np.int64)
        assert (alignment._unpacked(alignment._packed(keys), len(keys)) == keys).all()


@pytest.mark.parametrize("frequent", [0, 10, 1 << 19])
def test_equal_to_plain_loops(spark, table_of, tokenizers, frequent):
    path = "/root/testdata/sf0.001/documents.parquet"
    some = [r.text for r in spark.read.parquet(path).orderBy("doc_id").limit(12).collect()]
    rows = list(enumerate([*ODD, *some])) + [(3, ODD[3]), (None, some[0]), (None, None), (99, some[1])]
    docs = table_of(rows, ["n_a", "links", "key"])
    found = alignment.align_tokenizers(docs, BYTES, PIECES, frequent=frequent)
    assert _rows(found) == _brute(tokenizers, rows)


@pytest.mark.parametrize("most", [0, 5, 400_000])
def test_segments_give_the_tokens_of_whole_texts(most):
    own = alignment.Tokenizers(BYTES, PIECES, most)
    texts = ["word, isn't  it? naïve \n\n 東京 x1 " * 60, " lead " * 50, "a b\u00a0c \u2003 d" * 30, "no_spaces" * 100]
    texts += ["a ", " a", "a  ", "  ", "\n ", " \n a", "\x1c \x85 \x0b x", "x \u200b y", "don 't 's", "1 2  3   4 \t 5"]
    for some in (texts, texts[::-1], texts[3:]):
        a, b = own.encoded(some)
        whole_a = [own.a.encode(" " + t, add_special_tokens=False).ids for t in some]
        whole_b = [own.b.encode(t) for t in some]
        assert a[0].tolist() == sum(whole_a, []) and a[1].tolist() == [len(x) for x in whole_a]
        assert b[0].tolist() == sum(whole_b, []) and b[1].tolist() == [len(x) for x in whole_b]
    assert len(own.kept_a) <= most


def test_random_texts_equal_the_libraries(tokenizers):
    rng = np.random.default_rng(5)
    letters = list(" " * 12 + "\n\t\r\u00a0\u3000\x1f\x85abcé東's.,1😀_<>|")
    texts = ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3000)]
    a, b = tokenizers.encoded(texts)
    assert a[0].tolist() == sum((tokenizers.a.encode(" " + t, add_special_tokens=False).ids for t in texts), [])
    assert b[0].tolist() == sum(tokenizers.b.encode(texts), [])


def test_token_groups(spark, table_of, tokenizers):
    rows = list(enumerate(ODD))
    for r in alignment.token_groups(table_of(rows), BYTES, PIECES).collect():
        a, b, groups = _groups(tokenizers, ODD[r.doc_id])
        assert (r.a_ids, r.b_ids) == ([i for i, *_ in a], [i for i, *_ in b])
        starts = zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends)
        assert [(r.a_ids[p:q], r.b_ids[s:t]) for p, q, s, t in starts] == groups


def test_empty_table(spark, table_of):
    assert alignment.align_tokenizers(table_of([]), BYTES, PIECES).collect() == []
    assert [r.n_a for r in alignment.align_tokenizers(table_of([(1, None)]), BYTES, PIECES).collect()] == [0]


def test_query_on_the_table(spark, tokenizers):
    from kipimo.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in QUERIES["op12_alignment"](spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs[::9]:
        a, b, groups = _groups(tokenizers, d.text)
        r = found[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups) == (len(a), len(b), len(groups))
