"""Token counts by byte-pair merging with a heap over a linked list.

A segment's characters form a linked list.  A heap holds every adjacent pair that the
vocabulary can join, by rank and then by place; the lowest is popped and joined until
none is left.  The count is the characters at the start less the joins; no ids are
made.  A character that stays alone and is not in the vocabulary counts its UTF-8
bytes (byte fallback).

Pieces never hold the space sign after another character, so a text falls apart into
segments (spaces and the word after them) that merge on their own; equal segments are
merged once per worker and kept in a table of at most ``KEPT`` entries.  One very long
run without spaces is one segment and costs n log n.

Row-local: no shuffle, and a hot source or group of copies changes nothing.  Defined
cases: null and empty texts have no bytes and no tokens; repeated rows are each
counted; an empty table gives an empty result; other columns are not read.
"""

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import filled

KEPT = 400_000
LIMIT = 4096
_SPACE = "▁"
_SEGMENT = re.compile(" +[^ ]*")


class PieceCounter:
    """Counts tokens as the vocabulary file of a piece model gives them."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        usable = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        score = {model.id_to_piece(i): model.get_score(i) for i in usable}
        if any(_SPACE in p.lstrip(_SPACE) for p in score):
            raise ValueError("pieces cross spaces: texts cannot be cut at spaces")
        if any(c not in score for p in score for c in p):
            raise ValueError("a piece holds a character that is no piece")
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        number = {p: k for k, p in enumerate(score)}
        self.symbol = {p: k for p, k in number.items() if len(p) == 1}
        # (left << 20 | right) -> rank of the joined piece << 20 | the piece
        self.pair = {
            number[p[:i]] << 20 | number[p[i:]]: ranks[score[p]] << 20 | number[p]
            for p in score
            for i in range(1, len(p))
            if p[:i] in number and p[i:] in number
        }
        self.kept = {}

    def merged(self, segment: str) -> int:
        """Tokens of one segment whose spaces are space signs already."""
        pair = self.pair.get
        part = list(map(self.symbol.get, segment))
        n = count = len(part)
        if None in part:
            for i, p in enumerate(part):
                if p is None:
                    count += len(segment[i].encode()) - 1
                    part[i] = -1  # joins with nothing
        best = [pair(a << 20 | b) if a >= 0 <= b else None for a, b in zip(part, part[1:])]
        best.append(None)  # best[i]: what i and its right neighbour would make
        heap = [(e >> 20) << 32 | i for i, e in enumerate(best) if e is not None]
        if not heap:
            return count
        heapify(heap)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            e = best[i]
            if e is None or e >> 20 != top >> 32:
                continue  # joined otherwise meanwhile
            count -= 1
            j = right[i]
            k = right[i] = right[j]
            best[j] = None
            part[i] = made = e & 0xFFFFF
            best[i] = None
            if k < n:
                left[k] = i
                b = part[k]
                if b >= 0:
                    e = pair(made << 20 | b)
                    if e is not None:
                        best[i] = e
                        heappush(heap, (e >> 20) << 32 | i)
            h = left[i]
            if h >= 0:
                a = part[h]
                if a >= 0:
                    e = best[h] = pair(a << 20 | made)
                    if e is not None:
                        heappush(heap, (e >> 20) << 32 | h)
        return count

    def count(self, text: str) -> int:
        """Tokens of one text."""
        if not text:
            return 0
        if "  " in text or text[0] == " " or _SPACE in text:
            segments = _SEGMENT.findall(" " + text.replace(_SPACE, " "))
        else:
            segments = text.split(" ")  # each with the one space before it left out
        kept = self.kept
        try:
            return sum(map(kept.__getitem__, segments))
        except KeyError:
            pass
        total = 0
        for s in segments:
            c = kept.get(s)
            if c is None:
                spaced = s.replace(" ", _SPACE) if s[:1] == " " else _SPACE + s
                c = self.merged(spaced)
                if len(s) < 64:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[s] = c
            total += c
        return total


@lru_cache(maxsize=1)
def _counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def count_tokens(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def counted(batches):
        counter = _counter(model_file)
        for batch in batches:
            text = filled(batch.column(1))
            n_bytes = pc.binary_length(text).cast(pa.int64())
            n_tokens = pa.array((counter.count(x.as_py()) for x in text), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
