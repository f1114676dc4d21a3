"""Byte-level BPE encoding and decoding, long texts in overlapping chunks.

A text of up to ``chunk`` characters is encoded where it lies.  A longer one is cut
into chunks that overlap by ``overlap`` characters, dealt out over all tasks and
pre-tokenised from wherever each begins.  The pattern looks only ahead, so once two
neighbours have a boundary at the same place they agree from there on: the first
common boundary after a non-space is the stitch.  Between stitches lie the pieces,
which are encoded on their own (a piece ends after a non-space, so no look-ahead
crosses its end) and put back in order.  Where two neighbours have no common boundary
in the overlap, the piece goes on through the next chunk.

Decoding concatenates the raw bytes of the ids.

Only long texts are shuffled; one row of input, and so one text's ids, is the most
that a task holds together.  Defined cases: null and empty texts give no ids;
repeated rows each give a row (equal long rows are encoded once and counted); null
ids of documents are kept; an empty table gives an empty result; other columns are not
read.
"""

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textblock import filled, slices

CHUNK, OVERLAP = 32_768, 1_024


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    """The encoding of a file of base64 tokens and ranks."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def _ids(encoder, text: str) -> np.ndarray:
    return np.array(encoder.encode_ordinary(text), np.int32)


def _encoder_of_rows(rank_file: str, pattern: str):
    def encode(batches):
        encoder = encoding(rank_file, pattern)
        for batch in batches:
            text = filled(batch.column(1))
            for lo, hi in slices(text):
                ids = [_ids(encoder, t.as_py()) for t in text.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(ids)], ["doc_id", "ids"])

    return encode


def _chunker(chunk: int, overlap: int):
    def cut(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                key = f"{doc_id.as_py()}:{hashlib.sha256(text.encode()).hexdigest()}"
                starts = range(0, max(len(text) - overlap, 1), chunk)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * n),
                        pa.array([doc_id.as_py()] * n, batch.schema.field(0).type),
                        pa.array(range(n), pa.int32()),
                        pa.array([s + chunk if s != starts[-1] else len(text) for s in starts], pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array([text[s : s + chunk + overlap if s != starts[-1] else len(text)] for s in starts]),
                    ],
                    ["key", "doc_id", "part", "until", "start", "piece"],
                )

    return cut


def _pretokeniser(pattern: str, chunk: int, overlap: int):
    def bounds(batches):
        import regex

        match = regex.compile(pattern)
        for batch in batches:
            head, tail = [], []
            for start, text in zip(batch.column("start").to_pylist(), batch.column("piece").to_pylist()):
                at = [m.start() for m in match.finditer(text)]
                at = [p for p in at if p and not text[p - 1].isspace()]
                head.append([start + p for p in at if p < overlap])
                tail.append([start + p for p in at if chunk <= p < chunk + overlap])
            columns = [*batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "head", "tail"])

    return bounds


def pieces_of_long_texts(docs: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The stitched pieces of all texts longer than ``chunk``.

    key, doc_id, copies (how many equal rows), piece_no, piece: the pieces of a key in
    the order of piece_no make up the text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"key string, doc_id {kind}, part int, until long, start long, piece string"
    long = docs.filter(F.char_length("text") > chunk)
    chunks = (
        long.mapInArrow(_chunker(chunk, overlap), fields)
        .groupBy("key", "part")  # also deals a text's chunks out over the tasks
        .agg(
            F.count(F.lit(1)).alias("copies"),
            *[F.first(c).alias(c) for c in ("doc_id", "until", "start", "piece")],
        )
        .select("key", "part", "copies", "doc_id", "until", "start", "piece")
    )
    cut = chunks.mapInArrow(
        _pretokeniser(pattern, chunk, overlap),
        f"key string, part int, copies long, doc_id {kind}, until long, start long, piece string,"
        " head array<long>, tail array<long>",
    )
    order = Window.partitionBy("key").orderBy("part")
    stitched = cut.withColumn("stitch", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    stitched = stitched.withColumn("begin", F.lag("stitch").over(order)).withColumn(
        "piece_no",
        F.last(F.when((F.col("part") == 0) | F.col("begin").isNotNull(), F.col("part")), True).over(order),
    )
    begin = F.coalesce("begin", "start")
    text = F.substring(
        F.col("piece"), (begin - F.col("start") + 1).cast("int"), (F.coalesce("stitch", "until") - begin).cast("int")
    )
    parts = stitched.select("key", "doc_id", "copies", "piece_no", F.struct("part", text.alias("text")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "")
    return parts.groupBy("key", "piece_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), joined.alias("piece")
    )


def encode_texts(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    with_bytes: bool = False,
) -> DataFrame:
    """doc_id and ids (array of int): one row per row of ``docs``.

    ``with_bytes`` also decodes them, as ``decode_ids`` does, in the worker that encoded them.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must be between 1 and chunk")
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    encode = _encoder_of_rows(rank_file, pattern)
    short = chosen.filter(F.col("text").isNull() | (F.char_length("text") <= chunk))
    pieces = pieces_of_long_texts(chosen, pattern, chunk, overlap)
    tag = F.struct("key", "doc_id", "copies", "piece_no").alias("doc_id")
    encoded = pieces.select(tag, F.col("piece").alias("text")).mapInArrow(
        encode, f"doc_id struct<key: string, doc_id: {kind}, copies: bigint, piece_no: int>, ids array<int>"
    )
    whole = (
        encoded.select("doc_id.*", "ids")
        .groupBy("key")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("copies").alias("copies"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "ids"))), lambda p: p["ids"])).alias("ids"),
        )
        .select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc_id", "ids")
    )
    if not with_bytes:
        return short.mapInArrow(encode, f"doc_id {kind}, ids array<int>").unionByName(whole)
    decode = _decoder_of_rows(rank_file, pattern)

    def both(batches):
        return decode(encode(batches))

    rows = short.mapInArrow(both, f"doc_id {kind}, ids array<int>, bytes binary")
    return rows.unionByName(decode_ids(whole, rank_file, pattern))


def _decoder_of_rows(rank_file: str, pattern: str):
    def decode(batches):
        decoder = encoding(rank_file, pattern)
        for batch in batches:
            raw = [decoder.decode_bytes(ids.values.to_pylist()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    return decode


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes that its ids stand for."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    decode = _decoder_of_rows(rank_file, pattern)
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids array<int>, bytes binary")


def digests(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """n_tokens, and SHA-256 of the ids as text and of the decoded bytes."""
    return decoded.select(
        "doc_id",
        *(["ids"] if keep_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
