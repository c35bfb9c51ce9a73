"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut wherever a 16-byte gear hash is the smallest among the ``LEAST`` ones
before and behind it, so cuts follow the content and come back into step after an
insertion. Where a text repeats itself within that reach, equal hashes cut it into equal pieces.
Cuts are at least ``LEAST`` bytes apart and rarely more than four times that, so that
a passage of 50 words in other surroundings holds whole chunks; a chunk longer than ``MOST`` is cut
at every ``MOST`` bytes of itself. Chunks
are deduplicated by a 128-bit digest: the row of the smallest id keeps a
chunk, and inside one row its first occurrence.

Defined results: null and empty texts have no chunks; every row is a document of its
own, told apart by its id and a hash of its text, and what is removed from one is held by another: rows of one id rank by that hash, rows
with a null id come after all others and rank by it too; rows that repeat id and text keep
the same; an empty table gives an empty result; further
columns are left out.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import scratch, small_batches, written

LEAST, MOST = 24, 1024
_WINDOW = 16
_GEAR = np.random.default_rng(811).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes that end at each position; what precedes a text counts as nothing."""
    lens = np.diff(offs)
    place = np.arange(len(data)) + (_WINDOW - 1) * np.repeat(np.arange(len(lens)), lens)
    h = np.zeros(len(data) + (_WINDOW - 1) * len(lens), np.uint32)
    h[place] = _GEAR[data]
    step = 1
    while step < _WINDOW:
        # A hash over 2 * step bytes is the later half plus the earlier one shifted.
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h[place]


def _least_of(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the ``n`` values that begin at each position, as far as there are so many."""
    step = 1
    while 2 * step <= n:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (n - step)], h[n - step :])


def candidates(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions whose hash is at most the ``LEAST`` before and behind it, in the same text."""
    lens = np.diff(offs)
    place = LEAST + np.arange(len(data)) + LEAST * np.repeat(np.arange(len(lens)), lens)
    h = np.full(len(data) + LEAST * (len(lens) + 1), 2**32 - 1, np.uint32)
    own = gear_hashes(data, offs)
    h[place] = own
    least = _least_of(h, LEAST)
    return np.flatnonzero((own <= least[place - LEAST]) & (own <= least[place + 1]))


def _apart(found: np.ndarray) -> np.ndarray:
    """Without those less than ``LEAST`` bytes behind the last kept; only texts that repeat themselves have such."""
    close = np.flatnonzero(np.diff(found) < LEAST) + 1
    keep, last, before = np.ones(len(found), bool), 0, -1
    at = found[close].tolist()
    for k, x in zip(close.tolist(), at, strict=True):
        last = int(found[k - 1]) if k - 1 != before else last
        keep[k] = x - last >= LEAST
        last, before = (x, k) if keep[k] else (last, k)
    return found[keep]


def cut_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all chunks of a block of texts, in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.unique(offs[1:][np.diff(offs) > 0])
    begins = np.concatenate([[0], ends[:-1]])
    found = candidates(data, offs) + 1
    found = found[~np.isin(found, ends)]
    text = np.searchsorted(ends, found, "right")
    found = _apart(found[(found - begins[text] >= LEAST) & (ends[text] - found >= LEAST)])
    marks = np.unique(np.concatenate([begins, found, [len(data)]]))
    start, end = marks[:-1], marks[1:]
    pieces = -(-(end - start) // MOST)
    first = np.repeat(start, pieces) + MOST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return first, np.append(first[1:], len(data))


_CHUNKED = "id long, row long, n_bytes long, n_chunks long, repeats array<struct<start:int,size:int>>, high array<long>, low array<long>, start array<int>, size array<int>"


def _lists(values: np.ndarray, counts: list[int], kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _chunk(batches):
    for batch in batches:
        data, offs = kernel.as_bytes(batch.column(2))
        n, again, digests, starts, sizes, counts = [], [], [], [], [], []
        for _, _, raw, at in kernel.blocks(data, offs):
            start, end = cut_points(raw, at)
            bounds = np.searchsorted(start, at)
            view = raw.tobytes()
            start, end = start.tolist(), end.tolist()
            for k in range(len(at) - 1):
                seen, mine, zero = set(), [], int(at[k])
                a, b = (bounds[k], bounds[k + 1]) if at[k + 1] > at[k] else (0, 0)
                for s, e in zip(start[a:b], end[a:b], strict=True):
                    d = blake2b(view[s:e], digest_size=16).digest()
                    if d in seen:
                        mine.append({"start": s - zero, "size": e - s})
                    else:
                        seen.add(d)
                        digests.append(d)
                        starts.append(s - zero)
                        sizes.append(e - s)
                n.append(int(b - a))
                again.append(mine)
                counts.append(len(seen))
        pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(offs), pa.int64()), pa.array(n, pa.int64()), pa.array(again, pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))), _lists(pairs[:, 0].copy(), counts, pa.int64()), _lists(pairs[:, 1].copy(), counts, pa.int64()), _lists(np.array(starts, np.int32), counts, pa.int32()), _lists(np.array(sizes, np.int32), counts, pa.int32())],
            ["id", "row", "n_bytes", "n_chunks", "repeats", "high", "low", "start", "size"],
        )


LAST = 2**63 - 1


def row_key(key: Column, text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(key.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def repeated_chunks(docs: DataFrame, key="doc_id", text="text") -> tuple[DataFrame, DataFrame]:
    """The chunked documents, and (id, row, start, size) of the chunks that a row before has too; null ids are ``LAST``."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(key).cast("long").alias("id"), row_key(F.col(key), F.col(text)).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chunked = written(base.mapInArrow(_chunk, _CHUNKED), "chunked")
    each = F.explode(F.arrays_zip("high", "low", "start", "size")).alias("c")
    rows = chunked.select(F.coalesce("id", F.lit(LAST)).alias("id"), "row", each).select("id", "row", "c.high", "c.low", "c.start", "c.size")
    # A chunk that a third of all documents share is one row of each task here.
    owners = rows.groupBy("high", "low").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner <> last").select("high", "low", "owner")
    repeated = rows.join(owners, ["high", "low"]).filter("id > owner").select("id", "row", "start", "size")
    # Ids of several texts: there the smallest row key goes first.
    several = chunked.groupBy(F.coalesce("id", F.lit(LAST)).alias("id")).agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a <> b").select("id")
    several = written(several, "several")
    if not several.isEmpty():
        tied = rows.join(several, "id", "left_semi")
        first = tied.groupBy("high", "low", "id").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a <> b").drop("b")
        repeated = repeated.unionByName(tied.join(first, ["high", "low", "id"]).filter("row > a").select("id", "row", "start", "size"))
    return chunked, repeated


def substring_dedup(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(key, n_bytes, n_chunks, n_repeated, n_removed, spans) of each row; spans are the removed (start, size), in order.

    n_repeated counts the removed chunks, n_removed their bytes.
    """
    return _removed(docs, key, text).select(F.col("id").alias(key), "n_bytes", "n_chunks", "n_repeated", "n_removed", "spans")


def _removed(docs: DataFrame, key: str, text: str) -> DataFrame:
    with scratch(docs.sparkSession):
        chunked, repeated = repeated_chunks(docs, key, text)
        # A row's chunks at most, however many rows repeat it.
        gone = repeated.distinct().groupBy("id", "row").agg(F.collect_list(F.struct("start", "size")).alias("spans")).withColumnsRenamed({"id": "of", "row": "of_row"})
        kind = "array<struct<start:int,size:int>>"
        joined = chunked.join(gone, (F.col("row") == F.col("of_row")) & (F.coalesce("id", F.lit(LAST)) == F.col("of")), "left")
        spans = F.array_sort(F.concat("repeats", F.coalesce("spans", F.array().cast(kind))))
        total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["size"])
        told = joined.select("id", "row", "n_bytes", "n_chunks", spans.alias("spans"))
        return written(told.select("*", F.size("spans").cast("long").alias("n_repeated"), total.alias("n_removed")), "removed", keep=True)


def _cut(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            raw, at, parts = (text or "").encode(), 0, []
            for s in spans or ():
                parts.append(raw[at : s["start"]])
                at = s["start"] + s["size"]
            out.append((b"".join(parts) + raw[at:]).decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])


def deduplicated_texts(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(key, text) without the removed chunks; half a character at a cut is left out too."""
    spans = _removed(docs, key, text).select("id", "row", "spans").dropDuplicates(["id", "row"])
    base = docs.select(F.col(key).cast("long").alias("own"), row_key(F.col(key), F.col(text)).alias("own_row"), F.col(text).cast("string").alias("text"))
    joined = base.join(spans, (F.col("own_row") == F.col("row")) & F.col("own").eqNullSafe(F.col("id")), "left")
    return joined.select("own", "text", "spans").mapInArrow(_cut, "id long, text string").withColumnRenamed("id", key)
