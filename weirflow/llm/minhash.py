"""Near-duplicates by MinHash with one permutation, confirmed on full shingle sets.

1. One pass takes each text's distinct 5-word shingles. One hash of each shingle
   picks its bin and its rank there; a bin keeps its smallest. Empty bins are
   filled by optimal densification: each bin has its own fixed order of the
   other bins and copies the first that is not empty.
2. Texts of equal sets are one node from here on, so copies cost nothing more.
3. Bins are banded. In each bucket only star edges, from every node to the
   smallest, become candidates: a bucket of n nodes has n - 1.
4. Candidates are confirmed on the full sets. A hub's nodes are dealt in chunks,
   so no task holds a hub's whole group.
5. A bucket whose nodes are not all in one component by then gets more stars:
   rounds of 4, 32, 256, ... further hubs, each joined to the nodes of other
   components that have not been hubs before it. A round makes as many
   pairs as its hubs times the bucket's nodes at most, components are found anew after it,
   and buckets of which every node has been a hub leave. It ends when every node of
   every open bucket has been one, so no pair that shares a bucket is left
   untried, and nothing is capped. A bucket's nodes meet in one Arrow kernel, those of a large one
   in blocks of hubs and nodes. Before a pair is confirmed, exact upper bounds of its
   intersection must allow the similarity: the sizes, what each set shares with
   other components at all, and the same by hash group. A pair that shares several
   buckets is made in the first of them alone.

With 48 bands of 4 bins a pair of similarity 0.75 shares no bucket with a chance of
1e-8, and less above it.

Defined results: null texts and texts without words have no shingles, are their own
component and stay; texts of one to four words have their whole sequence as
their shingle. Every row is a document of its own, and ids only rank them: rows that
share an id but not a text are linked or not as any others are. Null ids come last: a
component is led by its smallest id, and only where no row has one by null; ``kept`` compares
ids, so rows that repeat the leading id are all marked, while ``without_near_duplicates`` leaves exactly one
row of each component. An empty table gives an empty result; further
columns are left out. Nodes are digests of sets: 64 bits name them, and where 128 tell apart what 64
do not, the names are made anew.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .store import scratch, small_batches, written

WIDTH = 5
BANDS, ROWS = 48, 4
BINS = BANDS * ROWS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Up to so many nodes with candidates are broadcast to find their texts, and so many keys of rows that go: 32 bytes each at most.
BROADCAST_NODES = 1_000_000
#: Members of a hub that are confirmed together.
CHUNK = 64

_rng = np.random.default_rng(575)
#: For each bin the place of every other bin in its order of densification.
_ORDER = np.argsort(_rng.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.uint16)
_U = np.uint64


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin, of a sorted array of distinct hashes that is not empty."""
    bins = ((shingles >> _U(32)) * _U(BINS)) >> _U(32)
    first = np.concatenate([[0], np.flatnonzero(bins[1:] != bins[:-1]) + 1])
    full, least = bins[first].astype(np.int64), shingles[first]
    out = np.empty(BINS, np.uint64)
    out[full] = least
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        out[empty] = least[_ORDER[np.ix_(empty, full)].argmin(axis=1)]
    return out


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    rows = signature(shingles).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1).astype(np.uint64) * kernel.MULTIPLIERS[40]
    for k in range(ROWS):
        out += rows[:, k] * kernel.MULTIPLIERS[k]
    return kernel.mix(out)


def digest(shingles: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """A 128-bit digest of a sorted set as two numbers; none of an empty one."""
    if not len(shingles):
        return None, None
    raw = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


_SIGNED = "row long, id long, n long, high long, low long, bands array<long>"


def _sign(batches):
    for batch in batches:
        data, offs = kernel.as_bytes(batch.column(2))
        n, digests, bands = [], [], []
        for _, _, raw, at in kernel.blocks(data, offs):
            for shingles in kernel.shingle_sets(raw, at, WIDTH):
                n.append(len(shingles))
                digests.append(digest(shingles))
                bands.append(band_hashes(shingles).view(np.int64) if len(shingles) else None)
        counts = np.array([0 if b is None else BANDS for b in bands])
        flat = np.concatenate([b for b in bands if b is not None]) if counts.any() else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, pa.int64()))
        high, low = (pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), high, low, lists], ["row", "id", "n", "high", "low", "bands"])


def _check_node(batches):
    """Of rows (node, high, low, text) those whose text has the node's set; keys of rows may clash."""
    for batch in batches:
        data, offs = kernel.as_bytes(batch.column(3))
        own = [digest(s) for _, _, raw, at in kernel.blocks(data, offs) for s in kernel.shingle_sets(raw, at, WIDTH)]
        want = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        same = pa.array([a == b for a, b in zip(own, want, strict=True)], pa.bool_())
        yield batch.filter(same).select([0, 3])


_FOUND = "hub long, node long, both long, either long"


def _confirm(batches):
    """Rows in order of hub and chunk, the hub's own text first: intersection and union of each member with its hub."""
    key, base = None, None
    for batch in batches:
        hubs, chunks, nodes = (batch.column(k).to_pylist() for k in range(3))
        data, offs = kernel.as_bytes(batch.column(3))
        out, k = [], 0
        for _, _, raw, at in kernel.blocks(data, offs):
            for shingles in kernel.shingle_sets(raw, at, WIDTH):
                if nodes[k] is None:
                    key, base = (hubs[k], chunks[k]), shingles
                elif key == (hubs[k], chunks[k]):
                    place = np.minimum(np.searchsorted(base, shingles), max(0, len(base) - 1))
                    both = int((base[place] == shingles).sum()) if len(base) else 0
                    out.append((hubs[k], nodes[k], both, len(base) + len(shingles) - both))
                else:
                    raise ValueError("a chunk came without its hub")
                k += 1
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(4)], ["hub", "node", "both", "either"])


def _told(few: DataFrame) -> DataFrame:
    """``few``, which has been written, to be sent to every executor up to a counted number of rows, and joined beyond it."""
    return F.broadcast(few) if few.count() <= BROADCAST_NODES else few


def _texts(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """One whole text for each of ``nodes`` (node, row, high, low)."""
    nodes = written(nodes, "involved")
    found = written(base.join(_told(nodes), "row").select("node", "high", "low", "text").mapInArrow(_check_node, "node long, text string"), "node-texts")
    # Only rows that repeat id and text give a node several texts.
    return found if found.count() <= nodes.count() else written(found.dropDuplicates(["node"]), "node-texts")


def _dealt(pairs: DataFrame) -> DataFrame:
    """(hub, chunk, node): the pairs (hub, node) dealt in chunks of about ``CHUNK`` nodes, and a row without a node for each chunk."""
    sizes = written(pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "sizes")
    members = pairs.join(_told(sizes), "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node")
    heads = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("node"))
    return written(members.unionByName(heads), "dealt")


def confirm(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, node, both, either): the pairs (hub, node) of ``dealt`` with the sizes of intersection and union."""
    # Keys go to the texts, so that a text is sent to the hubs that it is compared with and nowhere else.
    keys = _told(dealt.select(F.coalesce("node", "hub").alias("of"), "hub", "chunk", F.col("node").alias("member")))
    rows = texts.join(keys, F.col("node") == F.col("of")).select("hub", "chunk", F.col("member").alias("node"), "text")
    rows = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("node").asc_nulls_first())
    return written(rows.mapInArrow(_confirm, _FOUND), "confirmed")


def _spread(batches):
    """(node, shingle) of each node's text, a block of text at a time."""
    for batch in batches:
        data, offs = kernel.as_bytes(batch.column(1))
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        for first, _, raw, at in kernel.blocks(data, offs):
            sets = list(kernel.shingle_sets(raw, at, WIDTH))
            own = np.repeat(nodes[first : first + len(sets)], [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())], ["node", "shingle"])


#: A set's shingles are counted in so many groups by hash; the smaller counts of two sets bound their intersection.
GROUPS = 32
#: Hubs of a bucket in the first round after the stars, and how many times more there are up to each next one.
HUBS, STEP = 4, 8
#: Hubs of a bucket that are compared in one task, with as many of its nodes.
BLOCK = 2048


def _bounds(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, most, groups) of ``nodes`` (node, part): its size, what it shares with other parts at all, and that by hash group."""
    rows = written(texts.join(_told(nodes.select("node")), "node", "left_semi").select("node", "text").mapInArrow(_spread, "node long, shingle long"), "open-sets")
    seen = rows.join(_told(nodes), "node").groupBy("shingle").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("shingle", F.lit(True).alias("met"))
    # Written first, so that up to a counted number is broadcast and, beyond it, a shingle of very many rows is split among tasks.
    met = rows.join(_told(written(seen, "met")), "shingle", "left").withColumn("g", F.when(F.col("met"), F.pmod("shingle", F.lit(GROUPS))))
    groups = [F.count_if(F.col("g") == k).cast("int").alias(f"g{k}") for k in range(GROUPS)]
    counted = met.groupBy("node").agg(F.count("*").alias("n"), F.count("g").alias("most"), *groups)
    return counted.select("node", "n", "most", F.array(*[f"g{k}" for k in range(GROUPS)]).alias("groups"))


_PAIRS = "hub long, chunk long, node long"


def _meet(low: float, high: float):
    """Rows in order of bucket, h and m: the pairs whose hub has its turn from ``low`` to ``high``, as ``confirm`` takes them."""

    def of(rows: pa.RecordBatch, key: tuple[int, int, int], out: list[tuple]) -> None:
        part = rows.column(5).to_numpy()
        if (part == part[0]).all():
            return
        role, node, turn, n, most = (rows.column(k).to_numpy() for k in (3, 4, 6, 7, 8))
        groups = rows.column(9).flatten().to_numpy().reshape(-1, GROUPS)
        opens: dict[int, set[int]] = {}

        def shares(k: int) -> set[int]:
            return opens[k] if k in opens else opens.setdefault(k, set(rows.column(10)[k].as_py()))

        for x in np.flatnonzero((role != 1) & (turn >= low) & (turn < high)).tolist():
            later = (turn > turn[x]) | ((turn == turn[x]) & (node > node[x]))
            y = np.flatnonzero(later & (role != 0) & (part != part[x]))
            # Sets of n and m have 75 / 175 * (n + m) shingles in common at least.
            least = (n[y] + n[x]) * PERCENT
            fits = (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * PERCENT) & (np.minimum(most[y], most[x]) * (100 + PERCENT) >= least)
            y, least = y[fits], least[fits]
            y = y[np.minimum(groups[y], groups[x]).sum(axis=1, dtype=np.int64) * (100 + PERCENT) >= least]
            # Of the buckets that both are in, the first makes the pair.
            nodes = [int(node[k]) for k in y.tolist() if min(shares(x) & shares(k)) == key[0]]
            for k in range(0, len(nodes), CHUNK):
                chunk = hash((*key, k))
                out += [(int(node[x]), chunk, v) for v in (None, *nodes[k : k + CHUNK])]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["hub", "chunk", "node"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            out: list[tuple] = []
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in pairwise([0, *cuts.tolist(), len(keys)] if len(keys) else []):
                if held and key != tuple(keys[a].tolist()):
                    of(held[0] if len(held) == 1 else pa.concat_batches(held), key, out)
                    held = []
                key = tuple(keys[a].tolist())
                held.append(batch.slice(a, b - a))
            yield made(out)
        out = []
        if held:
            of(held[0] if len(held) == 1 else pa.concat_batches(held), key, out)
        yield made(out)

    return run


def _blocks(live: DataFrame, low: int, high: int, large: bool) -> DataFrame:
    """``live`` with the block of hubs ``h`` and of nodes ``m`` where each row is compared, and its role: 0 a hub, 1 a node, 2 both."""
    zero, facts = F.lit(0).cast("long"), ["node", "part", "turn", "n", "most", "groups", "opens"]
    whole = live.select("bucket", zero.alias("h"), zero.alias("m"), F.lit(2).alias("role"), *facts)
    if not large:
        return whole
    # Only a bucket of more than BLOCK nodes is several blocks: each hub goes to all blocks of nodes and each node to all blocks of hubs.
    wide = live.filter(F.col("size") > BLOCK).withColumn("hs", F.ceil(F.least("size", F.lit(high - low)) / BLOCK)).withColumn("ms", F.ceil(F.col("size") / BLOCK))
    each = lambda count: F.explode(F.sequence(zero, F.col(count) - 1))
    own = lambda count: F.pmod(F.xxhash64("bucket", "node"), F.col(count))
    hubs = wide.filter(F.col("turn") < high).select("bucket", own("hs").alias("h"), each("ms").alias("m"), F.lit(0).alias("role"), *facts)
    members = wide.select("bucket", each("hs").alias("h"), own("ms").alias("m"), F.lit(1).alias("role"), *facts)
    few = live.filter(F.col("size") <= BLOCK).select("bucket", zero.alias("h"), zero.alias("m"), F.lit(2).alias("role"), *facts)
    return few.unionByName(hubs).unionByName(members)


def further_components(shared: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) by ``links`` and by those between nodes of one bucket that its first star has missed."""

    def placed(entries: DataFrame, parts: DataFrame) -> DataFrame:
        return entries.join(_told(parts), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")

    parts = components(links)
    first = written(placed(shared.filter("size > 2").select("bucket", "node", "size"), parts), "placed")
    live = written(first.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("bucket"), "live")
    entries = written(first.join(_told(live), "bucket", "left_semi").drop("part"), "open")
    if entries.isEmpty():
        return parts
    known = written(placed(entries.groupBy("node").agg(F.collect_list(F.struct("bucket", "size")).alias("opens")), parts), "open-nodes")
    # Over a third of a set that fits no other part's is a set that is similar to none.
    bounds = _bounds(texts, known.select("node", "part")).filter(F.col("most") * 100 >= F.col("n") * PERCENT)
    facts = written(bounds.join(known.select("node", "opens"), "node"), "open-facts")
    # When a node's turn as hub of a bucket comes: its place in a random order, about.
    turn = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("size")
    each = facts.select("node", "n", "most", "groups", F.col("opens.bucket").alias("opens"), F.inline("opens").alias("bucket", "size"))
    entries = written(each.withColumn("turn", turn), "entries")
    texts = written(texts.join(_told(facts.select("node")), "node", "left_semi"), "open-texts")
    top = entries.agg(F.max("size")).first()[0] or 0
    low, high = 0, HUBS
    while low < top:
        # An entry whose turn is over has met all others of its bucket.
        turns = placed(entries.filter((F.col("size") > low) & (F.col("turn") >= low)), parts)
        blocks = _blocks(turns, low, high, top > BLOCK).repartition("bucket", "h", "m").sortWithinPartitions("bucket", "h", "m")
        pairs = written(blocks.mapInArrow(_meet(low, high), _PAIRS), "rest")
        more = pairs if pairs.isEmpty() else written(_links(confirm(pairs, texts)), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = components(links)
        low, high = high, high * STEP
    return parts


def _links(found: DataFrame) -> DataFrame:
    return found.filter(F.col("both") * 100 >= F.col("either") * PERCENT).select(F.col("hub").alias("u"), F.col("node").alias("v"))


def near_duplicates(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row."""
    leads = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("lead.id"))
    return _judged(docs, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), leads.alias("component_id"), F.col("id").eqNullSafe(leads).alias("kept"))


def _row_key(key: Column, text: Column) -> Column:
    return F.xxhash64(key.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def _named(signed: DataFrame) -> DataFrame:
    """``signed`` with the name of each row's set, ``node``: the first half of its digest, or, where two sets share that, a hash of both halves."""
    clash = written(signed.filter("n > 0").groupBy("high").agg(F.min("low").alias("a"), F.max("low").alias("b")).filter("a <> b").select(F.col("high").alias("of")), "clash")
    found = signed.join(clash, F.col("high") == F.col("of"), "left")
    return written(found.withColumn("node", F.when(F.col("of").isNull(), F.col("high")).otherwise(F.xxhash64("low", "high"))).drop("of"), "signatures")


def _nodes(signed: DataFrame) -> DataFrame:
    """The leading row of each node, the number of its rows, and whether they are of several sets."""
    ranked = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row", "n", "high", "low", "at")).alias("x")
    found = signed.filter("n > 0").groupBy("node").agg(ranked, F.count("*").alias("copies"), (F.min("low") < F.max("low")).alias("several"))
    return written(found.select("node", "x.*", "copies", "several"), "nodes")


def _judged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, n, lead) of each row: its key and size, and the id and row key that lead its component, null without shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark):
        base = docs.select(_row_key(F.col(key), F.col(text)).alias("row"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        signed = written(base.mapInArrow(_sign, _SIGNED).withColumn("at", F.monotonically_increasing_id()), "signatures")
        nodes = _nodes(signed.withColumn("node", F.col("high")))
        if nodes.agg(F.bool_or("several")).first()[0]:
            signed = _named(signed)
            nodes = _nodes(signed)
        else:
            signed = signed.withColumn("node", F.col("high"))
        # Equal sets have equal bands: those of the leading row are taken where they lie, so that bands are not shuffled.
        copied = written(nodes.filter("copies > 1").select("node", F.col("at").alias("first")), "copied")
        leading = signed.filter("n > 0").join(_told(copied), "node", "left").filter("first IS NULL OR first = at")
        # Dealt by bucket once, for the sizes and for the entries.
        banded = leading.select(F.explode("bands").alias("bucket"), "node").repartition("bucket")
        hubs = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1")
        shared = written(banded.join(hubs, "bucket"), "buckets")
        stars = written(shared.filter("node <> hub").select("hub", "node").distinct(), "stars")
        involved = stars.select("hub").union(stars.select("node")).distinct().withColumnRenamed("hub", "node").join(nodes.select("node", "row", "high", "low"), "node")
        texts = _texts(base.select("row", "text"), involved)
        links = written(_links(confirm(_dealt(stars), texts)), "links")
        parts = further_components(shared, texts, links)
        root = nodes.select("node", F.struct("no", "id", "row").alias("own")).join(_told(parts), "node", "left").select("node", "own", F.coalesce("root", "node").alias("root"))
        led = root.groupBy("root").agg(F.min("own").alias("lead"))
        of = root.join(led, "root").select("node", "lead")
        return written(signed.select("row", "id", "n", "node").join(of, "node", "left").select("row", "id", "n", "lead"), "judged", keep=True)


def without_near_duplicates(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """One row of ``docs`` of each component: that of the smallest id; of rows that repeat id and text, that of the smallest values."""
    judged = _judged(docs, key, text)
    gone = judged.filter((F.col("n") > 0) & (F.col("row") != F.col("lead.row"))).select(F.col("row").alias("__row"), F.col("id").alias("__id")).distinct()
    gone = written(gone, "gone")
    # A counted number of keys goes to every executor, so that no text is shuffled; more are joined.
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    own = _row_key(F.col(key), F.col(text))
    stay = docs.join(gone, (own == F.col("__row")) & F.col(key).cast("long").eqNullSafe(F.col("__id")), "left_anti")
    again = written(judged.filter((F.col("n") > 0) & (F.col("row") == F.col("lead.row"))).groupBy("row").count().filter("count > 1").select(F.col("row").alias("__row")), "again")
    if again.isEmpty():
        return stay
    names = [f"c{k}" for k in range(len(docs.columns))]
    whole = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    few = stay.join(again, own == F.col("__row"), "left_semi").groupBy(own.alias("__row")).agg(F.min_by(whole, F.to_json(whole)).alias("x")).select("x.*").toDF(*docs.columns)
    return stay.join(again, own == F.col("__row"), "left_anti").unionByName(few)
