"""Token ids in files: Simple-8b words with escapes and block offsets.

Ids are packed into 64-bit words.  The top four bits select how many values of how
many bits the other sixty hold; selector 0 is an escape, and the word after it is one
value of up to 64 bits.  Every ``BLOCK`` values start a new word, and the offsets of
the blocks' first words are kept, so that decoding expands all words of one selector
at once and any block can be read alone.

A file is a Parquet table written by Spark, so it lies on whatever store the cluster
shares.  A row is a frame: some consecutive documents, their ids' number and packed
words.  Documents are in ascending order of doc_id over (part, frame), and equal ids
of documents in the order of their texts.

Texts are sorted by range before they are encoded (their bytes are fewer than their
ids' would be); a range is one task, and its words of text are looked up in a table of
at most ``KEPT`` entries before the tokenizer is asked.  Only one count per partition
comes to the driver.  One document is never split, so the longest text bounds a frame.

Defined cases: null and empty texts give the end id alone; null ids of documents come
first; repeated rows are each written; an empty table writes and reads no frames;
other columns are not read.
"""

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblock import filled

BLOCK = 1024
FRAME_IDS = 1 << 15
KEPT = 1_200_000
FREQUENT = 50_000
#: Fixed by the format: values per word by selector; their bits are 60 // values.
VALUES = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = 60 // VALUES
_U = np.uint64


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; above 53 bits perhaps one more than it does."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that hold the values, and the offset of each block's first word."""
    values = np.asarray(values, _U)
    if not len(values):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    n, reach = -(-len(values) // BLOCK), int(VALUES[1:].max())
    padded = np.zeros((n, BLOCK + reach), _U)  # zeros behind each block
    whole = len(values) // BLOCK
    padded[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < n:
        padded[whole, : len(values) - whole * BLOCK] = values[whole * BLOCK :]
    width = _widths(padded)
    chosen = np.zeros((n, BLOCK), np.uint8)  # the escape, until a selector fits
    widest, span = width[:, :BLOCK].copy(), 1
    for selector in range(len(VALUES) - 1, 0, -1):  # from one value to sixty
        while span < VALUES[selector]:
            np.maximum(widest, width[:, span : span + BLOCK], out=widest)
            span += 1
        fits = widest <= BITS[selector]
        if not fits.any():
            break  # more values cannot fit into fewer bits
        chosen[fits] = selector
    held = VALUES.astype(np.uint8)[chosen].tobytes()
    starts, firsts = [], np.zeros(n, np.int64)
    for b in range(n):
        at, stop = b * BLOCK, min((b + 1) * BLOCK, len(values))
        firsts[b] = len(starts)
        while at < stop:
            starts.append(at)
            at += held[at]
    starts = np.array(starts)
    select = chosen.ravel()[starts]
    words = select.astype(_U) << _U(60)
    flat, place = padded.ravel(), starts // BLOCK * (BLOCK + reach) + starts % BLOCK
    for s in np.unique(select[select > 0]):
        mine = np.flatnonzero(select == s)
        total, at = words[mine], place[mine]
        for j in range(VALUES[s]):
            total |= flat[at + j] << _U(int(BITS[s]) * j)
        words[mine] = total
    escapes = np.flatnonzero(select == 0)
    if len(escapes):
        words = np.insert(words, escapes + 1, values[starts[escapes]])
        firsts = firsts + np.searchsorted(escapes, firsts)
    return words, firsts


def unpack(words: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """The n values of packed words."""
    if not n:
        return np.zeros(0, _U)
    select = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(select == 0):
        if not raw[i]:
            raw[i + 1] = True
    at_word = np.flatnonzero(~raw)
    select = select[at_word]
    count = VALUES[select]
    begin = np.cumsum(count) - count
    of_block = np.searchsorted(firsts, at_word, "right") - 1
    first_of_block = begin[np.searchsorted(at_word, firsts)]
    place = of_block * BLOCK + begin - first_of_block[of_block]
    out = np.zeros(len(firsts) * BLOCK + 64, _U)
    end = (of_block + 1) * BLOCK
    for s in np.unique(select):
        mine = np.flatnonzero(select == s)
        if s == 0:
            out[place[mine]] = words[at_word[mine] + 1]
            continue
        mask = _U((1 << int(BITS[s])) - 1)
        held = words[at_word[mine]]
        for j in range(VALUES[s]):
            inside = place[mine] + j < end[mine]
            out[place[mine][inside] + j] = (held[inside] >> _U(int(BITS[s]) * j)) & mask
    return out[:n]


#: Small letters that no normal form changes, and words of nothing else.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.islower() and c not in "\xaa\xb5\xba")
_plain = re.compile(f"[{_LETTERS}]+").fullmatch
_STOPS = b".,;:!?"


def _byte_chars() -> dict[int, int]:
    """What byte-level tokenizers write for the bytes that do not print."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_HIDDEN = _byte_chars()


def _byte_level(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(_HIDDEN)


class _Table(dict):
    """What words stand for, made when first asked for.

    Words asked for again are looked up here, in a table that is small enough for a
    processor's cache; all others, most of which never come again, in ``rare``.
    """

    def __init__(self, made):
        self.made = made
        self.rare: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.rare.get(word)
        if ids is None:
            ids = self.made(word)
            if len(self.rare) < KEPT:
                self.rare[word] = ids
        elif len(self) < FREQUENT:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts by a tokenizer that never joins across ASCII white space.

    Nor does it join letters with what follows them, and it ignores the case of ASCII
    letters; so a word of letters and stops is looked up as its two parts, if its last
    letter stays one when normalised.  The table
    takes words until it is full, which the frequent ones are in by then.

    Most words that are not in it are rare ones of plain letters.  If the tokenizer takes
    such a word as one piece of byte-level text, its model is asked directly: normalising
    and splitting would give the word back.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.kept = _Table(self._encoded)
        self.letters: dict[str, bool] = {}
        self.direct = self._whole_letters()

    def _whole_letters(self) -> bool:
        """Whether plain letters of any case are one byte-level piece, in small letters."""
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normalizer is None or splitter is None:
            return False
        upper = "".join(c.upper() for c in _LETTERS if c.upper().lower() == c)
        return all(
            normalizer.normalize_str(given) == small
            and [piece for piece, _ in splitter.pre_tokenize_str(small)] == [_byte_level(small)]
            for given, small in ((_LETTERS, _LETTERS), (upper, upper.lower()))
        )

    def ids(self, text: bytes) -> np.ndarray:
        # split of bytes: at space and 0x09-0x0D only
        return np.frombuffer(b"".join(map(self.kept.__getitem__, text.split())), "<u4")

    def _stays_letter(self, last: str) -> bool:
        """Whether a word's last letter still is one when normalised.

        Some end in a combining mark then, which the tokenizer joins with stops.
        """
        if last < "\x80":
            return True
        known = self.letters.get(last)
        if known is None:
            normal = self.tokenizer.normalizer.normalize_str(last)
            known = self.letters[last] = bool(normal) and normal[-1].isalpha()
        return known

    def _encoded(self, word: bytes) -> bytes:
        core = word.rstrip(_STOPS)
        text = core.decode()
        small = text.lower()
        plain = self.direct and _plain(small)
        if plain:
            first = small.encode()
        elif text.isalpha() and self._stays_letter(text[-1]):
            first = core.lower()
        else:
            first = word
        if first != word:
            stops = word[len(core) :]
            return self.kept[first] + self.kept[stops] if stops else self.kept[first]
        if plain:
            ids = [t.id for t in self.model.tokenize(_byte_level(small))]
        else:
            ids = self.tokenizer.encode_batch_fast([word.decode()], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def _word_encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


def _frame(part: int, frame: int, before: int, ids: list, rows: list[np.ndarray], lengths: list[int], kind):
    values = np.concatenate(rows)
    words, firsts = pack(values)
    columns = [
        pa.array([part], pa.int32()),
        pa.array([frame], pa.int32()),
        pa.array([before], pa.int64()),
        pa.array([len(values)], pa.int64()),
        pa.array([ids], pa.list_(kind)),
        pa.array([lengths], pa.list_(pa.int64())),
        pa.array([words.astype("<u8").tobytes()], pa.binary()),
        pa.array([firsts.astype("<i8").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, _FIELDS)


_FIELDS = ["part", "frame", "before", "n_ids", "doc_ids", "lengths", "words", "offsets"]


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode all texts, each with ``end_id`` behind it, into files below ``path``."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def frames(batches):
        encoder = _word_encoder(tokenizer_file)
        part, frame, before, held, ids, rows, lengths = TaskContext.get().partitionId(), 0, 0, 0, [], [], []
        key, end = pa.int64(), np.array([end_id], "<u4")
        for batch in batches:
            key = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0), filled(batch.column(1)).cast(pa.binary())):
                row = encoder.ids(text.as_py())
                ids.append(doc_id.as_py())
                rows += [row, end]
                lengths.append(len(row) + 1)
                held += len(row) + 1
                if held >= FRAME_IDS:
                    yield _frame(part, frame, before, ids, rows, lengths, key)
                    frame, before, held, ids, rows, lengths = frame + 1, before + held, 0, [], [], []
        if rows:
            yield _frame(part, frame, before, ids, rows, lengths, key)

    schema = (
        f"part int, frame int, before long, n_ids long, doc_ids array<{kind}>, lengths array<bigint>,"
        " words binary, offsets binary"
    )
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(frames, schema).write.option("compression", "none").parquet(path)


def _opened(spark: SparkSession, path: str):
    """The frames below ``path``, and a function that decodes their batches.

    It gives (doc_ids, starts, offsets, ids) of one frame after the other.
    """
    frames = spark.read.parquet(path)
    sizes = sorted(frames.groupBy("part").agg(F.sum("n_ids")).collect())  # one row per partition
    before = dict(zip([p for p, _ in sizes], np.cumsum([0] + [n for _, n in sizes]).tolist()))

    def decoded(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, _, offset, n, ids, lengths, words, firsts = (column[k] for column in batch.columns)
                words, firsts = np.frombuffer(words.as_py(), "<u8"), np.frombuffer(firsts.as_py(), "<i8")
                values = unpack(words, firsts, n.as_py())
                offsets = np.concatenate([[0], np.cumsum(lengths.values.to_numpy())]).astype(np.int64)
                yield ids.values, before[part.as_py()] + offset.as_py() + offsets[:-1], offsets, values

    return frames.select(*_FIELDS), decoded


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of every document, from files written before.

    start counts the ids of all documents before it.
    """
    frames, decoded = _opened(spark, path)
    kind = frames.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches):
        for ids, starts, offsets, values in decoded(batches):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts), lists], ["doc_id", "start", "ids"])

    return frames.mapInArrow(documents, f"doc_id {kind}, start long, ids array<bigint>")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from files written before.

    The CRC-32 is that of each document's ids as little-endian 32-bit integers.
    """
    frames, decoded = _opened(spark, path)
    kind = frames.schema["doc_ids"].dataType.elementType.simpleString()

    def sums(batches):
        for ids, starts, offsets, values in decoded(batches):
            raw = memoryview(values.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(starts), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return frames.mapInArrow(sums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
