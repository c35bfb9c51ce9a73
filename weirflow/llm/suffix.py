"""Exact substring dedup: bytes covered by a 50-byte string of an earlier document.

Of all suffixes only a sample is sorted: those at the minimizers of the 50-byte
windows, so that equal windows have equal sample suffixes at equal offsets. The
windows between are induced from the sample:

1. Each text gives runs: neighbouring windows with the same sample suffix. A
   run's tuple is (hash of the suffix's first K bytes, digest of all bytes of
   the run, place). A task settles copies among its own texts and sends one of
   each digest, the one of the smallest id.
2. Tuples are dealt by suffix hash and sorted bucket by bucket. Equal digests settle a run
   at once: every window of it starts in the smaller document too. Runs that
   share only the suffix go on.
3. These are few (the ends of repeated passages); their bytes are fetched, and
   each of their windows is compared with all windows of the same suffix.
4. Settled windows meet their texts again, which gives the removed bytes.

Tuples travel as column blocks, one for each task and bucket, not as rows.
Buckets are about BUCKET_BYTES of text each, so what a task holds does not grow with
the input, and a partition takes several buckets in turn once there are more than ``PARTITIONS``. Equality is that of
hashes: 64 bits of a run's bytes beside the hash of its suffix, and 64 bits of a window's bytes among the windows of one suffix. Of
10 million different runs of one suffix two clash with a chance of 3 in a million.

Defined results: null counts as empty; texts under 50 bytes keep everything;
rows of equal id never shorten one another; rows with a null id come after all others and
not before one another; an empty table gives an empty result; further columns
are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import scratch, small_batches, written

LENGTH = 50
#: Bytes of the sampled suffix that pick it; windows have LENGTH - K + 1 places for it.
K = 16
#: Bytes of text whose tuples meet in one bucket, on average.
BUCKET_BYTES = 8 << 20
#: Buckets beyond so many share partitions, which a driver must schedule.
PARTITIONS = 1 << 15
#: Bytes of text whose tuples a task holds before it sends them.
FLUSH_BYTES = 8 << 20

_U = np.uint64
LAST = 2**63 - 1


def runs_of(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """The runs of a block: first window, number of windows, offset of the suffix, its hash, the run's digest."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = kernel.prefix_hash(data)
    at = np.arange(n - k + 1)
    grams = kernel.span_hash(sums, at, at + k)
    # The smaller hash first, then the earlier place: one number to compare.
    low = (grams >> _U(32) << _U(32)) | at.astype(np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & _U(0xFFFFFFFF)).astype(np.int64)
    # Windows that stay inside their text.
    good = np.zeros(len(place) + 1, np.int32)
    sizes = np.diff(offs)
    long = sizes >= length
    np.add.at(good, offs[:-1][long], 1)
    np.add.at(good, offs[1:][long] - length + 1, -1)
    good = np.cumsum(good[:-1]).astype(bool)
    new = good.copy()
    new[1:] &= ~(good[:-1] & (place[1:] == place[:-1]))
    # A text that begins right where the last window of another ended is a new run too.
    starts = offs[:-1][long]
    new[starts] = True
    ends = good.copy()
    ends[:-1] &= ~good[1:] | new[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(ends)
    anchor = place[first]
    count, offset = last - first + 1, anchor - first
    whole = kernel.span_hash(sums, first, last + length)
    return first, count, offset, grams[anchor], kernel.mix(whole + (count * 256 + offset).astype(np.uint64) * kernel.MULTIPLIERS[60])


def _doc_key(ids: list, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row, from its id and its text."""
    own = np.array([LAST if i is None else i for i in ids], np.int64).view(np.uint64)
    texts = np.concatenate([kernel.span_hash(kernel.prefix_hash(raw), at[:-1], at[1:]) for _, _, raw, at in kernel.blocks(data, offs)]) if len(ids) else np.zeros(0, np.uint64)
    return kernel.mix(own * kernel.MULTIPLIERS[61] + texts)


_TUPLES = "bucket int, block binary"
_COLUMNS = (("hash", np.uint32), ("digest", np.uint64), ("key", np.int64), ("id", np.int64), ("start", np.uint32), ("count", np.uint8), ("offset", np.uint8))


def _pack(hashes, digests, doc, start, count, offset, keys, ids) -> bytes:
    """A column block: the documents that occur once each, then the tuples."""
    docs, mine = np.unique(doc, return_inverse=True)
    order = np.lexsort((start, mine))
    mine, start = mine[order], start[order]
    new = np.ones(len(mine), bool)
    new[1:] = mine[1:] != mine[:-1]
    per = np.diff(np.append(np.flatnonzero(new), len(mine)))
    packed = digests[order].tobytes()
    parts = [ids[docs].tobytes(), keys[docs].tobytes(), per.astype(np.uint32).tobytes(), start.astype(np.uint32).tobytes(), count[order].astype(np.uint8).tobytes(), offset[order].astype(np.uint8).tobytes()]
    small = pa.compress(b"".join(parts), codec="zstd", asbytes=True)
    return np.array([len(docs), len(mine), len(small)], np.int64).tobytes() + small + hashes[order].astype(np.uint32).tobytes() + packed


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    n_docs, n, size = np.frombuffer(raw, np.int64, 3)
    small = pa.decompress(raw[24 : 24 + size], decompressed_size=int(20 * n_docs + 6 * n), codec="zstd", asbytes=True)
    at, out = 0, {}
    for name, kind, m in (("ids", np.int64, n_docs), ("keys", np.int64, n_docs), ("per", np.uint32, n_docs), ("start", np.uint32, n), ("count", np.uint8, n), ("offset", np.uint8, n)):
        out[name] = np.frombuffer(small, kind, m, at)
        at += int(m) * np.dtype(kind).itemsize
    out["id"], out["key"] = np.repeat(out.pop("ids"), out["per"]), np.repeat(out.pop("keys"), out["per"])
    out["hash"] = np.frombuffer(raw, np.uint32, n, 24 + int(size))
    out["digest"] = np.frombuffer(raw, np.uint8, 8 * n, 24 + int(size) + 4 * int(n)).view(np.uint64)
    del out["per"]
    return out


def _settle(hashes: np.ndarray, digests: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tuples: whether a smaller id has the same digest; and which stand for theirs (one of the smallest id)."""
    order = np.lexsort((ids, digests, hashes))
    h, d, i = hashes[order], digests[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else i
    done, stands = np.zeros(len(order), bool), np.zeros(len(order), bool)
    done[order] = i > least
    stands[order] = i == least
    return done, stands


def _spans(key, start, count) -> bytes:
    return np.rec.fromarrays([key, start, count], dtype=[("key", "<i8"), ("start", "<u4"), ("count", "<u4")]).tobytes()


_SPAN = np.dtype([("key", "<i8"), ("start", "<u4"), ("count", "<u4")])


def _tuples(buckets: int):
    """Blocks of tuples by bucket; runs that a task settles itself go through as blocks of negative bucket."""

    def run(batches):
        held: list[tuple] = []
        held_bytes = 0

        def send():
            key = np.concatenate([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            doc = np.concatenate([x[2] + b for x, b in zip(held, np.cumsum([0] + [len(x[0]) for x in held[:-1]]), strict=True)])
            start, count, offset, grams, digest = (np.concatenate([x[k] for x in held]) for k in range(3, 8))
            bucket = (grams >> _U(32)) % _U(buckets)
            short = grams.astype(np.uint32)
            done, _ = _settle(grams, digest, ids[doc])
            out: list[tuple[int, bytes]] = []
            where = np.flatnonzero(done)
            for a in range(0, len(where), 200_000):
                w = where[a : a + 200_000]
                out.append((-1 - int(a // 200_000) % buckets, _spans(key[doc[w]], start[w], count[w])))
            left = np.flatnonzero(~done)
            left = left[np.argsort(bucket[left], kind="stable")]
            marks = np.searchsorted(bucket[left], np.arange(buckets + 1))
            for b in range(buckets):
                w = left[marks[b] : marks[b + 1]]
                if len(w):
                    out.append((b, _pack(short[w], digest[w], doc[w], start[w], count[w], offset[w], key, ids)))
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out[a : a + 64]], pa.int32()), pa.array([x[1] for x in out[a : a + 64]], pa.binary())], ["bucket", "block"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = kernel.as_bytes(batch.column(1))
            keys = _doc_key(ids, data, offs).view(np.int64)
            own = np.array([LAST if i is None else i for i in ids], np.int64)
            for first, end, raw, at in kernel.blocks(data, offs):
                start, count, offset, grams, digest = runs_of(raw, at)
                doc = np.searchsorted(at, start, "right") - 1
                held.append((keys[first:end], own[first:end], doc, start - at[doc], count, offset, grams, digest))
                held_bytes += len(raw)
                if held_bytes >= FLUSH_BYTES:
                    yield from send()
                    held, held_bytes = [], 0
        if held:
            yield from send()

    return run


_SETTLED = "key long, span long"
#: A span is one number: start, number of windows, offset, and whether its bytes are still to be compared.


def pack_span(start, count, offset=0, asked=0):
    return (np.asarray(start, np.int64) << 24) | (np.asarray(count, np.int64) << 16) | (np.asarray(offset, np.int64) << 8) | np.asarray(asked, np.int64)


def _rows(keys: np.ndarray, spans: np.ndarray):
    for a in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000], pa.int64()), pa.array(spans[a : a + 100_000], pa.int64())], ["key", "span"])


def _sort_bucket(blocks: list[bytes]):
    """Settled runs of one bucket, and those whose suffix has other digests."""
    parts = [_unpack(b) for b in blocks]
    x = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    done, stands = _settle(x["hash"], x["digest"], x["id"])
    yield from _rows(x["key"][done], pack_span(x["start"][done], x["count"][done]))
    order = np.lexsort((x["digest"], x["hash"]))
    order = order[stands[order]]
    h, d = x["hash"][order], x["digest"][order]
    new = np.ones(len(order), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    other = np.zeros(len(order), bool)
    other[1:] = (h[1:] == h[:-1]) & (d[1:] != d[:-1])
    mixed = np.bincount(group, weights=other, minlength=0) > 0 if len(order) else np.zeros(0, bool)
    ask = order[mixed[group]] if len(order) else order
    yield from _rows(x["key"][ask], pack_span(x["start"][ask], x["count"][ask], x["offset"][ask], 1))


def _sorted_buckets(batches):
    """Rows in order of bucket; a bucket is sorted when the next begins."""
    now, blocks = None, []
    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = block.as_py()
            if bucket < 0:
                spans = np.frombuffer(raw, _SPAN)
                yield from _rows(spans["key"].copy(), pack_span(spans["start"], spans["count"]))
                continue
            if bucket != now:
                if blocks:
                    yield from _sort_bucket(blocks)
                now, blocks = bucket, []
            blocks.append(raw)
    if blocks:
        yield from _sort_bucket(blocks)


def _squeeze(batches):
    """Texts as zstd bytes, with their row's key."""
    for batch in batches:
        data, offs = kernel.as_bytes(batch.column(1))
        keys = _doc_key(batch.column(0).to_pylist(), data, offs).view(np.int64)
        raw = data.tobytes()
        texts = [pa.compress(raw[a:b], codec="zstd", asbytes=True) if b > a else b"" for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), pa.array(np.diff(offs), pa.int64()), pa.array(texts, pa.binary())], ["key", "id", "size", "text"])


_SQUEEZED = "key long, id long, size long, text binary"


def _inflate(text: bytes, size: int) -> bytes:
    return pa.decompress(text, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _windows(buckets: int):
    """Blocks of contexts by bucket of their suffix: rows (key, id, size, text, spans) in, the bytes of asked runs out."""

    def run(batches):
        def send(held):
            hashes = np.array([h for h, *_ in held], np.uint64)
            bucket = (hashes >> _U(32)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            marks = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                w = order[marks[b] : marks[b + 1]]
                if len(w):
                    mine = [held[k] for k in w]
                    head = np.array([(key, i, start, count) for _, key, i, start, count, _ in mine], np.int64)
                    out.append((b, np.int64(len(mine)).tobytes() + head.tobytes() + b"".join(x[5] for x in mine)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([pa.compress(x[1], codec="zstd", asbytes=True) for x in out], pa.binary()), pa.array([len(x[1]) for x in out], pa.int64())], ["bucket", "block", "size"])

        held: list[tuple] = []
        for batch in batches:
            for key, i, size, text, spans in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                raw = _inflate(text, size)
                s = np.array(spans, np.int64)
                start, count, offset = s >> 24, (s >> 16) & 255, (s >> 8) & 255
                sums = kernel.prefix_hash(np.frombuffer(raw, np.uint8))
                grams = kernel.span_hash(sums, start + offset, start + offset + K)
                i = LAST if i is None else i
                held += [(g, key, i, a, n, raw[a : a + n + LENGTH - 1]) for g, a, n in zip(grams.tolist(), start.tolist(), count.tolist(), strict=True)]
                if len(held) >= 100_000:
                    yield from send(held)
                    held = []
        if held:
            yield from send(held)

    return run


_CONTEXTS = "bucket int, block binary, size long"


def _compare(batches):
    """Windows of one bucket's contexts that start in a document of smaller id too."""

    def settle(blocks):
        heads, texts = [], []
        for raw in blocks:
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            heads.append(np.frombuffer(raw, np.int64, 4 * n, 8).reshape(-1, 4))
            texts.append(raw[8 + 32 * n :])
        head, data = np.concatenate(heads), np.frombuffer(b"".join(texts), np.uint8)
        key, ids, start, count = head.T
        begin = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
        # Contexts of about one block of bytes at a time have their windows hashed.
        hashes = []
        step = max(1, kernel.BLOCK // 256)
        for a in range(0, len(count), step):
            lo, hi = begin[a], (begin[a + step] if a + step < len(count) else len(data))
            n = count[a : a + step]
            at = np.repeat(begin[a : a + step] - lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hashes.append(kernel.span_hash(kernel.prefix_hash(data[lo:hi]), at, at + LENGTH))
        h = np.concatenate(hashes)
        row = np.repeat(np.arange(len(count)), count)
        place = start[row] + np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        order = np.lexsort((ids[row], h))
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        least = ids[row[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = np.zeros(len(h), bool)
        hit[order] = ids[row[order]] > least
        w = np.flatnonzero(hit)
        # Neighbouring windows of a context are one span.
        begins = np.ones(len(w), bool)
        begins[1:] = (row[w][1:] != row[w][:-1]) | (w[1:] != w[:-1] + 1)
        first = np.flatnonzero(begins)
        yield from _rows(key[row[w[first]]], pack_span(place[w[first]], np.diff(np.append(first, len(w)))))

    now, blocks = None, []
    for batch in batches:
        for bucket, block, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if bucket != now:
                if blocks:
                    yield from settle(blocks)
                now, blocks = bucket, []
            blocks.append(pa.decompress(block, decompressed_size=size, codec="zstd", asbytes=True))
    if blocks:
        yield from settle(blocks)


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,size:long>>"


def removed_runs(spans: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of bytes that the packed spans' windows cover."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = spans >> 24
    end = start + ((spans >> 16) & 255) + length - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:] - 1, len(start) - 1)]


def _finish(batches):
    for batch in batches:
        out = []
        for _, i, size, text, spans in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            raw = _inflate(text, size)
            start, end = removed_runs(np.array(spans or [], np.int64))
            kept, at = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((i, size, int((end - start).sum()), len(start), kept.hexdigest(), [{"start": int(a), "size": int(b - a)} for a, b in zip(start, end, strict=True)]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def suffix_dedup(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row; spans are the removed runs."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    parts = min(buckets, PARTITIONS)
    with scratch(spark):
        tuples = base.mapInArrow(_tuples(buckets), _TUPLES).repartition(parts, "bucket").sortWithinPartitions("bucket")
        sorted_ = written(tuples.mapInArrow(_sorted_buckets, _SETTLED), "sorted")
        asked = (F.col("span") % 256) == 1
        # Rows that repeat id and text share a key and so their spans: as a set, a text's are as many as it has runs at most.
        wanted = sorted_.filter(asked).groupBy("key").agg(F.collect_set("span").alias("spans"))
        texts = base.mapInArrow(_squeeze, _SQUEEZED)
        contexts = texts.join(wanted, "key").select("key", "id", "size", "text", "spans").mapInArrow(_windows(buckets), _CONTEXTS)
        compared = written(contexts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare, _SETTLED), "compared")
        gone = sorted_.filter(~asked).unionByName(compared).groupBy("key").agg(F.collect_set("span").alias("spans"))
        joined = texts.join(gone, "key", "left").select("key", "id", "size", "text", "spans")
        return written(joined.mapInArrow(_finish, _RESULT), "suffixes", keep=True).withColumnRenamed("id", key)
