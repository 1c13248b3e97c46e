"""Best-fit packing by minimum bin slack.

Texts are tokenized once, in one narrow pass; only documents longer than a sequence are cut, their first piece being
the short one. Pieces of one length are interchangeable, so packing works on the number of pieces per length, at most
`capacity` rows, whatever the corpus holds. Per bin, the longest remaining piece is fixed and a bitset subset-sum
program over the available lengths, longest first, finds the fullest combination with it; the bin is repeated as often
as the counts allow, and removed. Each such pattern uses up a length, so their number is bounded by the lengths too.
Pieces then find their place by their exact rank among the pieces of their length (common.ranked), so that a length
which a third of all pieces share is still ranked in many tasks.

Token ids are those of the `tokenizers` library for byte_bpe_50k.json with add_special_tokens=False. They come from
the same vocabulary in tiktoken's form, several times as fast. Texts that hold a special token's string, which the two
libraries treat differently, and texts that tiktoken's pattern refuses (about a million blanks or line breaks in a row
exceed its stack) go through `tokenizers` itself. Tests compare the two.

Defined results: a null or empty text is one piece of length 1, the end id alone; a very long text, blank or without a
break, is tokenized whole and cut into as many pieces as it fills; repeated rows are packed each; rows of null doc_id
are packed and come back as null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, row_hash, scratch, written

CAPACITY, END = 2048, 0
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"


@cache
def _fast(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _exact(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """A document's ids, the end id included."""
    text, ids = text or "", None
    if SPECIAL not in text:
        try:
            ids = _fast(vocabulary).encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern's stack is too small for a very long run of white space
            pass
    if ids is None:
        ids = _exact(vocabulary).encode(text, add_special_tokens=False).ids
    return np.append(np.asarray(ids, "<u4"), np.uint32(END)).astype("<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [], [], [], [], []
            for doc, text in enumerate(b.column("text")):
                ids = token_ids(text.as_py(), vocabulary)
                at, to = 0, (len(ids) - 1) % capacity + 1
                k = 0
                while at < len(ids):
                    for column, value in zip(rows, (doc, k, at, to - at, zlib.crc32(ids[at:to].tobytes())), strict=True):
                        column.append(value)
                    at, to, k = to, to + capacity, k + 1
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows[0], pa.int64())), *[pa.array(c, k) for c, k in zip(rows[1:], kinds, strict=True)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: list[int], goal: int) -> list[tuple[int, int]]:
    """(length, copies) of the combination of at most counts[length] pieces each whose sum is largest without passing goal."""
    sums, steps, mask = 1, [], (1 << goal + 1) - 1
    for length in range(goal, 0, -1):
        left, some = min(counts[length], goal // length), 1
        while left > 0:
            some = min(some, left)
            steps.append((length, some, sums))
            sums |= sums << some * length & mask
            left -= some
            some *= 2
        if sums >> goal & 1:
            break
    at, out = sums.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + some
            at -= some * length
    return list(out.items())


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)]): bins that hold all counted pieces."""
    left = [counts.get(n, 0) for n in range(capacity + 1)]
    out, longest = [], capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        left[longest] -= 1
        bin_ = dict(fullest(left, capacity - longest))
        left[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[n] // k for n, k in bin_.items())
        for n, k in bin_.items():
            left[n] -= k * times
        out.append((times, sorted(bin_.items(), reverse=True)))


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, per: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text)."""
    folder = scratch(docs.sparkSession)
    p = written(pieces(docs, capacity, vocabulary), "pieces", folder)
    counts = {r["length"]: r["count"] for r in p.groupBy("length").count().collect()}  # at most `capacity` rows
    base = np.cumsum([0] + [counts.get(n, 0) for n in range(capacity + 1)])  # pieces shorter than n
    used, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for times, combination in patterns(counts, capacity):
        at = 0
        for n, k in combination:
            rows.append((int(base[n]) + used[n], k, sequence, at))
            used[n] += k * times
            at += n * k
        sequence += times
    first, copies, sequences, offsets = (np.array(c, np.int64) for c in (zip(*sorted(rows), strict=True) if rows else [[]] * 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = base[length] + rank
            i = np.searchsorted(first, at, "right") - 1
            nth = at - first[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequences[i] + nth // copies[i]), pa.array(offsets[i] + nth % copies[i] * length)], [*b.schema.names[:-1], "sequence_id", "offset"])

    buckets = F.element_at(F.lit([max(1, counts.get(n, 0) // per) for n in range(1, capacity + 1)]), F.col("length").cast("int")).cast("long")
    r = ranked(p, ["length"], buckets, row_hash(["doc_id", "piece"]), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema)
    return r.mapInArrow(place, f"{schema}, sequence_id long, offset long")
