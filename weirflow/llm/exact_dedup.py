"""Exact dedup by Patricia tries.

Texts meet in partitions by length and content hash and go, as full byte
strings, into compressed radix tries whose terminal nodes keep the owner (the
smallest rank; the largest id if ``keep="last"``) and the number of rows. A
batch collapses its own copies before the shuffle, so a text that a third of
all rows share sends one row per batch. Inside a partition Spark's spilling
sort brings rows in order of length, hash and bytes: a trie is complete when its
key ends, and while it is open every subtree that the order has passed is
emitted and cut off once the trie holds more than ``budget`` bytes.

Defined results: null counts as empty; empty texts are equal to one another;
rows with a null id own nothing while another row does; repeated rows are
copies; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written

#: Bytes of labels that one open trie may hold before passed subtrees leave it.
TRIE_BYTES = 64 << 20
_LOWEST = -(2**63)


class Node:
    """A node of a compressed radix trie: edges by first byte, each with its whole label."""

    __slots__ = ("edges", "owner", "rows")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.owner: int | None = None
        self.rows = 0


def _common(a: bytes, b: memoryview) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings with owner and row count at their terminal nodes."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.held, self.budget = Node(), 0, budget

    def insert(self, text: bytes, rank: int, rows: int = 1) -> None:
        node, rest = self.root, memoryview(text)
        while len(rest):
            edge = node.edges.get(rest[0])
            if edge is None:
                leaf = Node()
                node.edges[rest[0]] = (bytes(rest), leaf)
                self.held += len(rest)
                node, rest = leaf, rest[len(rest) :]
                break
            label, child = edge
            n = _common(label, rest)
            if n < len(label):
                middle = Node()
                middle.edges[label[n]] = (label[n:], child)
                node.edges[rest[0]] = (label[:n], middle)
                child = middle
            node, rest = child, rest[n:]
        node.owner = rank if node.owner is None else min(node.owner, rank)
        node.rows += rows

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        """Every string with its owner and rows, in byte order."""
        yield from self._below(self.root, b"")

    def _below(self, top: Node, path: bytes) -> Iterator[tuple[bytes, int, int]]:
        todo = [(top, path)]
        while todo:
            node, path = todo.pop()
            if node.owner is not None:
                yield path, node.owner, node.rows
            todo += [(child, path + label) for _, (label, child) in sorted(node.edges.items(), reverse=True)]

    def spill(self, current: bytes) -> Iterator[tuple[bytes, int, int]]:
        """Cut off what lies wholly before ``current`` in byte order, if the trie is over its budget."""
        if self.held <= self.budget:
            return
        node, path, kept = self.root, b"", 0
        while True:
            depth = len(path)
            here = current[depth] if depth < len(current) else 256
            for first in [b for b in node.edges if b < here]:
                label, child = node.edges.pop(first)
                yield from self._below(child, path + label)
            edge = node.edges.get(here)
            if edge is None or current[depth : depth + len(edge[0])] != edge[0]:
                break
            path, node, kept = path + edge[0], edge[1], kept + len(edge[0])
        self.held = kept


def _values(column) -> list:
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


_GROUPED = "len long, h int, norm binary, rank long, rows long"


def _collapse(sign: int):
    """Each batch's distinct texts with their smallest rank and number of rows."""

    def run(batches):
        for batch in batches:
            found: dict[bytes, list] = {}
            for i, raw in zip(batch.column(0).to_pylist(), _values(batch.column(1)), strict=True):
                rank = 2**63 - 1 if i is None else max(sign * i, _LOWEST + 1)
                mine = found.setdefault(raw.lower(), [rank, 0])
                mine[0], mine[1] = min(mine[0], rank), mine[1] + 1
            texts = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([int.from_bytes(hashlib.blake2b(t, digest_size=3).digest(), "big") for t in texts], pa.int32()),
                    pa.array(texts, pa.binary()),
                    pa.array([found[t][0] for t in texts], pa.int64()),
                    pa.array([found[t][1] for t in texts], pa.int64()),
                ],
                ["len", "h", "norm", "rank", "rows"],
            )

    return run


_OWNED = "sha string, rank long, rows long"


def _own(budget: int):
    """Rows in order of length, hash and bytes through one trie for each length and hash."""

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).hexdigest() for t, _, _ in found], pa.string()), pa.array([r for _, r, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())], ["sha", "rank", "rows"])

    def run(batches):
        key, trie, out = None, PatriciaTrie(budget), []
        for rows in batches:
            for n, h, text, rank, count in zip(*(rows.column(k).to_pylist() for k in range(5)), strict=True):
                if (n, h) != key:
                    out += [(t, r, c) for t, r, c in trie.terminals() if c > 1]
                    key, trie = (n, h), PatriciaTrie(budget)
                trie.insert(text, rank, count)
                out += [x for x in trie.spill(text) if x[2] > 1]
                if len(out) >= 500:
                    yield batch(out)
                    out = []
        yield batch(out + [x for x in trie.terminals() if x[2] > 1])

    return run


def _sign_texts(batches):
    for rows in batches:
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([hashlib.sha256(t.lower()).hexdigest() for t in _values(rows.column(1))], pa.string())], ["id", "sha"])


def exact_dedup(docs: DataFrame, key="doc_id", text="text", keep: str = "last", budget: int = TRIE_BYTES) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of each row; equal once A-Z are lower-cased.

    ``keep`` is "last" (the largest id stays) or "first". Of rows that repeat
    the id that stays, all say ``kept``.
    """
    small_batches(docs.sparkSession)
    sign = -1 if keep == "last" else 1
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    met = base.mapInArrow(_collapse(sign), _GROUPED).repartition("len", "h").sortWithinPartitions("len", "h", "norm")
    # A text of one row is its own owner; the others' owners are few, and written once.
    owners = written(met.mapInArrow(_own(budget), _OWNED), "owners")
    keep_id = F.when(F.col("rank") == 2**63 - 1, F.lit(None)).otherwise(F.col("rank") * sign)
    signed = base.mapInArrow(_sign_texts, "id long, text_sha256 string")
    joined = signed.join(owners, F.col("text_sha256") == F.col("sha"), "left")
    keep_id = F.when(F.col("rows").isNull(), F.col("id")).otherwise(keep_id)
    return joined.select(F.col("id").alias(key), keep_id.alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
