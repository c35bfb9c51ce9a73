"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders; what is left is
its template. Windows of five template tokens of the texts are joined by hash to those of the
benchmark items. Along one alignment of a text with an item the values in the
placeholders must be consistent: an item's value always stands for one value
of the text. An item leaks into a text that has 75 % of its windows, so that questions with
other numbers and names are caught as well as verbatim ones.

Names are capitalised words inside a sentence, runs of them one name; units are
words of a fixed list after a number. A window of placeholders alone would match
anything, so windows with fewer than two literal words match word for word by themselves.
They match as templates too along an alignment, which begins at any window with a literal word, and
where the consistent windows of the item's alignments cover ``EVIDENCE`` literal words of it at least. The value
that a placeholder of an item stands for along an alignment is the one that most of its tokens have there, the smallest of equals, so
neither end of the item decides for the other.

The windows of the benchmark are a table. The texts' distinct window hashes are joined to it: by broadcast
while it has a counted ``BROADCAST_WINDOWS`` rows at most, by a shuffle beyond, in one pass over the texts either way. Pairs of a
text and an item that share as many windows as a leak needs are candidates; only these have their tokens
compared, a text's items dealt in chunks of ``CHUNK``. Nothing but the lengths of short items comes to the driver.

Defined results: null and empty texts hold nothing; items without words leak
nowhere; an item of fewer than five tokens leaks into texts whose whole
template it is and, from ``SHORT`` words on, into texts that hold its very words in a row (one or two
words in a row mean nothing in a longer text); repeated items count once, and items of a null id leak without a name; an empty benchmark leaves every text
clean; repeated rows have one verdict, that of their text; further columns are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import scratch, small_batches, written

WIDTH = 5
LEAST = 0.75
#: A window of fewer literal words than this says nothing as a template and must match word for word.
LITERALS = 2
#: Literal words of an item that its alignments must cover before windows with fewer than ``LITERALS`` match as templates.
EVIDENCE = 3
#: Words from which on an item of fewer than ``WIDTH`` tokens is looked for inside texts.
SHORT = 3
#: Windows of alignments that are compared at once.
COMPARED = 1 << 20
#: Up to so many windows of the benchmark, and so many candidate texts, are broadcast: 40 bytes each.
BROADCAST_WINDOWS = 1 << 20
#: Items that are compared with one text together.
CHUNK = 64

# Unit words that follow a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles g kg mg lb lbs oz ounce ounces pound pounds ton tons tonne tonnes l ml cl liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp hz khz mhz ghz kb mb gb tb w kw kwh v a degree degrees kelvin celsius fahrenheit mph kmh".split()
LITERAL, NUMBER, NAME, UNIT = range(4)

_U = np.uint64
_units = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
_unit_hashes = np.sort(kernel.word_hashes(_units, *kernel.words(_units, np.array([0, len(_units)]))[:2]))
_DIGIT, _UPPER, _LOWERS, _STOP = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _LOWERS[97:123] = True
_STOP[[33, 46, 58, 63]] = True


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def templates(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block of texts: template hash, kind, value hash and text number."""
    keep = kernel.CORE[data]
    kept = _sums(keep)
    start, end, text = kernel.words(data, offs)
    solid = kept[end] > kept[start]
    start, end, text = start[solid], end[solid], text[solid]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    core, a, b = data[keep], kept[start], kept[end]
    value = kernel.word_hashes(core, a, b)
    digits, lowers, lines = _sums(_DIGIT[data]), _sums(_LOWERS[data]), _sums(data == 10)
    number = digits[end] > digits[start]
    second = core[np.minimum(a + 1, len(core) - 1)]
    capital = _UPPER[core[a]] | ((core[a] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (b - a > 1))
    opens = np.ones(len(start), bool)
    opens[1:] = (text[1:] != text[:-1]) | _STOP[data[end[:-1] - 1]] | (lines[start[1:]] > lines[start[:-1]])
    name = capital & ~number & ~opens & (lowers[end] > lowers[start])
    follows = np.zeros(len(start), bool)
    follows[1:] = text[1:] == text[:-1]
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & follows[1:] & ~number[1:]
    unit[unit] = np.isin(value[unit], _unit_hashes)
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, LITERAL))).astype(np.int8)
    first = np.ones(len(kind), bool)
    first[1:] = ~(follows[1:] & (kind[1:] == NAME) & (kind[:-1] == NAME))
    at = np.flatnonzero(first)
    # A run of names is one name; its value is that of its words together.
    value = np.add.reduceat(value, at)
    kind, text = kind[at], text[at]
    token = np.where(kind == LITERAL, value, kernel.MULTIPLIERS[52 + kind.astype(np.int64)])
    return token, kind, value, text


def plain_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value hash and text number of each word, names not put together."""
    keep = kernel.CORE[data]
    kept = _sums(keep)
    start, end, text = kernel.words(data, offs)
    solid = kept[end] > kept[start]
    if not solid.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return kernel.word_hashes(data[keep], kept[start[solid]], kept[end[solid]]), text[solid]


def _run_hash(value: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words; runs longer than a window are hashed in windows of windows."""
    if width <= WIDTH:
        return kernel.window_hash(value, width)
    runs, at = kernel.window_hash(value, WIDTH), np.arange(0, width - WIDTH + 1, WIDTH)
    at = np.unique(np.append(at, width - WIDTH))
    n = max(0, len(value) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in at.tolist():
        out = kernel.mix(out * kernel.MULTIPLIERS[58] + runs[k : k + n])
    return out


def window_keys(token: np.ndarray, kind: np.ndarray, value: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of each window: of its template, or of its very words where under ``LITERALS`` of them are literal."""
    runs = kernel.window_hash(token, width)
    if not len(runs):
        return runs
    literal = _sums(kind == LITERAL)
    plain = literal[width:] - literal[:-width] < LITERALS
    return np.where(plain, kernel.mix(kernel.window_hash(value, width) ^ kernel.MULTIPLIERS[59]), runs)


class Benchmark:
    """Sorted windows of a block of items, with the items' tokens."""

    def __init__(self, items: list[tuple[int | None, str]]):
        raw = [(t or "").encode() for _, t in items]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.ids = [i for i, _ in items]
        token, self.kind, self.value, text = templates(np.frombuffer(b"".join(raw), np.uint8), offs)
        bounds = np.searchsorted(text, np.arange(len(items) + 1))
        self.bounds = bounds
        runs = window_keys(token, self.kind, self.value)
        inside = text[: len(runs)] == text[WIDTH - 1 :] if len(runs) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        order = np.argsort(runs[at], kind="stable")
        self.at = at[order]
        self.hashes = runs[self.at]
        self.of = text[self.at]
        self.windows = np.maximum(np.diff(bounds) - WIDTH + 1, 0)
        # Alignments of items with windows of fewer than ``LITERALS`` literals begin at windows with one literal.
        self.runs = kernel.window_hash(token, WIDTH)
        literal = _sums(self.kind == LITERAL)
        count = literal[WIDTH:] - literal[:-WIDTH] if len(self.runs) else np.zeros(0, np.int64)
        dense = np.unique(text[at[count[at] < LITERALS]])
        begin = at[(count[at] > 0) & np.isin(text[at], dense)]
        self.begin = begin[np.argsort(self.runs[begin], kind="stable")]
        self.begin_hashes = self.runs[self.begin]
        self.begin_of = text[self.begin]
        self.short: dict[int, list[int]] = defaultdict(list)
        for k in range(len(items)):
            n = bounds[k + 1] - bounds[k]
            if 0 < n < WIDTH:
                a, b = bounds[k], bounds[k + 1]
                self.short[int(window_keys(token[a:b], self.kind[a:b], self.value[a:b], int(n))[0])].append(k)

        self.plain: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        if self.short:
            value, of = plain_words(np.frombuffer(b"".join(raw), np.uint8), offs)
            bounds = np.searchsorted(of, np.arange(len(items) + 1))
            for k in sorted(k for group in self.short.values() for k in group):
                n = int(bounds[k + 1] - bounds[k])
                if n >= SHORT:
                    self.plain[n][int(_run_hash(value[bounds[k] : bounds[k + 1]], n)[0])].append(k)

    def consistent(self, hits: list[tuple[int, int]], kind: np.ndarray, value: np.ndarray) -> set[int]:
        """Of one alignment's hits (text token, item token) those whose placeholders all have the value that most tokens of theirs have."""
        tokens = {q + j: p + j for p, q in hits for j in range(WIDTH) if self.kind[q + j] != LITERAL}
        slot = {q: (int(self.kind[q]), int(self.value[q])) for q in tokens}
        votes: dict[tuple[int, int], Counter[int]] = defaultdict(Counter)
        for q, p in tokens.items():
            votes[slot[q]][int(value[p])] += 1
        stands = {x: min(n, key=lambda v, n=n: (-n[v], v)) for x, n in votes.items()}
        return {q for _, q in hits if all(q + j not in tokens or int(value[tokens[q + j]]) == stands[slot[q + j]] for j in range(WIDTH))}

    def alignments(self, token: np.ndarray, text: np.ndarray) -> dict[tuple[int, int], list[list[tuple[int, int]]]]:
        """For each text and item, with enough of them for a closer look, the hits of each alignment by template alone."""
        runs = kernel.window_hash(token, WIDTH)
        lines: dict[tuple[int, int], list[list[tuple[int, int]]]] = defaultdict(list)
        if not len(runs) or not len(self.begin):
            return lines
        low, high = np.searchsorted(self.begin_hashes, runs, "left"), np.searchsorted(self.begin_hashes, runs, "right")
        hit = np.flatnonzero((high > low) & (text[: len(runs)] == text[WIDTH - 1 :]))
        low, high = low[hit], high[hit]
        near = np.repeat(hit, high - low)
        item = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(len(near)) if len(hit) else near
        found = np.unique(np.column_stack([text[near], self.begin_of[item], near - self.begin[item]]), axis=0)
        of, shift = found[:, 1], found[:, 2]
        equal = np.zeros(len(found), np.int64)

        def compare(a: int, b: int):
            n = self.windows[of[a:b]]
            line = np.repeat(np.arange(a, b), n)
            q = self.bounds[of[line]] + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
            p = q + shift[line]
            inside = (p >= 0) & (p < len(runs))
            line, p, q = line[inside], p[inside], q[inside]
            same = (runs[p] == self.runs[q]) & (text[p] == found[line, 0]) & (text[p + WIDTH - 1] == found[line, 0])
            return line[same], p[same], q[same]

        total = np.cumsum(self.windows[of])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(COMPARED, (total[-1] if len(total) else 0), COMPARED)), [len(found)]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            equal += np.bincount(compare(a, b)[0], minlength=len(found))
        # Rows are in order of text and item, so the alignments of a pair are neighbours.
        first = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])) if len(found) else np.zeros(0, np.int64)
        sums = np.add.reduceat(equal, first) if len(first) else equal
        for g in np.flatnonzero(sums >= LEAST * self.windows[of[first]]) if len(first) else ():
            a, b = int(first[g]), int(first[g + 1]) if g + 1 < len(first) else len(found)
            line, p, q = compare(a, b)
            for k in range(a, b):
                mine = line == k
                lines[int(found[a, 0]), int(of[a])].append(list(zip(p[mine].tolist(), q[mine].tolist(), strict=True)))
        return lines

    def leaks(self, data: np.ndarray, offs: np.ndarray) -> dict[int, dict[int, float]]:
        """For each text of a block the items that leak into it, with the share of their windows."""
        token, kind, value, text = templates(data, offs)
        out: dict[int, dict[int, float]] = defaultdict(dict)
        runs = window_keys(token, kind, value)
        if len(runs) and len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, runs), len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[place] == runs) & (text[: len(runs)] == text[WIDTH - 1 :]))
            low, high = np.searchsorted(self.hashes, runs[hit], "left"), np.searchsorted(self.hashes, runs[hit], "right")
            near = np.repeat(hit, high - low)
            item = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)]) if len(hit) else np.zeros(0, np.int64)
            # Only texts with enough windows of an item need a closer look.
            pair = text[near] * len(self.windows) + self.of[item] if len(hit) else np.zeros(0, np.int64)
            seen, back, counts = np.unique(pair, return_inverse=True, return_counts=True)
            enough = counts >= LEAST * self.windows[seen % len(self.windows)] if len(seen) else np.zeros(0, bool)
            lines: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
            for k in np.flatnonzero(enough[back]) if len(seen) else ():
                p, q = int(near[k]), int(self.at[item[k]])
                lines[int(text[p]), int(self.of[item[k]])][p - q].append((p, q))
            for (t, i), aligned in lines.items():
                good: set[int] = set()
                for hits in aligned.values():
                    good |= self.consistent(sorted(hits), kind, value)
                share = len(good) / self.windows[i]
                if share >= LEAST:
                    out[t][i] = float(share)
        for (t, i), aligned in self.alignments(token, text).items():
            if i in out.get(t, ()):
                continue
            good = set()
            for hits in aligned:
                good |= self.consistent(hits, kind, value)
            share = len(good) / self.windows[i]
            words = {q + j for q in good for j in range(WIDTH) if self.kind[q + j] == LITERAL}
            if share >= LEAST and len(words) >= EVIDENCE:
                out[t][i] = float(share)
        if self.short:
            bounds = np.searchsorted(text, np.arange(len(offs)))
            for t in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < WIDTH)):
                a, b = bounds[t], bounds[t + 1]
                for i in self.short.get(int(window_keys(token[a:b], kind[a:b], value[a:b], int(b - a))[0]), ()):
                    out[int(t)][i] = 1.0
        if self.plain:
            value, text = plain_words(data, offs)
            for n, known in self.plain.items():
                runs = _run_hash(value, n)
                for p in np.flatnonzero(np.isin(runs, np.array(list(known), np.uint64)) & (text[: len(runs)] == text[n - 1 :])) if len(runs) else ():
                    for i in known[int(runs[p])]:
                        out[int(text[p])][i] = 1.0
        return out


#: Kinds of hashes: a window's key, a window's template where an alignment may begin, a short text's whole template, words in a row.
KEY, BEGIN, WHOLE, ROW = range(4)


def _kind(hashes: np.ndarray, kind: int) -> np.ndarray:
    return kernel.mix(hashes ^ kernel.MULTIPLIERS[44 + kind])


def _item_windows(batches):
    """(h, item, need, width): the hashes that find an item, and how many of its kind a text must have; width tells rows of words."""
    for batch in batches:
        h, item, need, width = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bench = Benchmark([(None, text)])
            n = int(bench.windows[0])
            found = [(_kind(bench.hashes, KEY), int(np.ceil(LEAST * n)), 0)] if n else []
            if len(bench.begin):
                # Of n windows, b of which may begin an alignment, a leak misses a quarter of n at most.
                found.append((_kind(bench.begin_hashes, BEGIN), max(1, int(np.ceil(len(bench.begin) - (1 - LEAST) * n))), -1))
            found += [(_kind(np.array([x], np.uint64), WHOLE), 1, 0) for x in bench.short]
            found += [(_kind(np.array([x], np.uint64), ROW), 1, w) for w, known in bench.plain.items() for x in known]
            for hashes, least, w in found:
                h.append(hashes.view(np.int64))
                item += [key] * len(hashes)
                need += [least] * len(hashes)
                width += [w] * len(hashes)
        flat = np.concatenate(h) if h else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64()), pa.array(item, pa.int64()), pa.array(need, pa.int64()), pa.array(width, pa.int32())], ["h", "item", "need", "width"])


def _text_windows(widths: list[int], begins: bool):
    """(k1, k2, hashes): the distinct hashes of each text by which items are found."""

    def run(batches):
        for batch in batches:
            data, offs = kernel.as_bytes(batch.column(2))
            for first, end, raw, at in kernel.blocks(data, offs):
                token, kind, value, text = templates(raw, at)
                bounds = np.searchsorted(text, np.arange(len(at)))
                keys = window_keys(token, kind, value)
                parts = [(text[: len(keys)], _kind(keys, KEY), text[: len(keys)] == text[WIDTH - 1 :])] if len(keys) else []
                if begins and len(keys):
                    parts.append((text[: len(keys)], _kind(kernel.window_hash(token, WIDTH), BEGIN), text[: len(keys)] == text[WIDTH - 1 :]))
                few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < WIDTH))
                for t in few.tolist():
                    a, b = int(bounds[t]), int(bounds[t + 1])
                    parts.append((np.array([t]), _kind(window_keys(token[a:b], kind[a:b], value[a:b], b - a), WHOLE), np.ones(1, bool)))
                if widths:
                    words, of = plain_words(raw, at)
                    for w in widths:
                        runs = _run_hash(words, w)
                        if len(runs):
                            parts.append((of[: len(runs)], _kind(runs, ROW), of[: len(runs)] == of[w - 1 :]))
                of = np.concatenate([t[ok] for t, _, ok in parts]) if parts else np.zeros(0, np.int64)
                h = np.concatenate([x[ok] for _, x, ok in parts]) if parts else np.zeros(0, np.uint64)
                order = np.lexsort((h, of))
                of, h = of[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
                of, h = of[new], h[new]
                marks = np.searchsorted(of, np.arange(end - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(marks), pa.array(h.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), lists], ["k1", "k2", "hashes"])

    return run


def _compare(batches):
    """(k1, k2, ids, share) of rows (k1, k2, text, items as (id, text)): the items that leak."""
    for batch in batches:
        out = []
        for k1, k2, text, items in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            bench = Benchmark([(x["id"], x["text"]) for x in items])
            raw = np.frombuffer(text.encode(), np.uint8)
            mine = bench.leaks(raw, np.array([0, len(raw)], np.int64)).get(0, {})
            if mine:
                out.append((k1, k2, sorted({bench.ids[i] for i in mine if bench.ids[i] is not None}), max(mine.values())))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], ["k1", "k2", "ids", "share"])


def _text_keys(text: str) -> list[Column]:
    """A verdict belongs to a text: 96 bits of hash name it."""
    c = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(c).alias("k1"), F.hash(F.lit(7), c).alias("k2")]


def leaks(docs: DataFrame, benchmark: DataFrame, text="text", item_key="item_id", item_text="text", most: int = BROADCAST_WINDOWS) -> DataFrame:
    """(k1, k2, items, share) of the texts that items leak into, by the keys of ``_text_keys``."""
    spark = docs.sparkSession
    small_batches(spark)

    def counted(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= most else table

    with scratch(spark):
        items = benchmark.select(F.col(item_key).cast("long").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
        items = written(items.withColumn("item", F.xxhash64("id", "text")), "items")
        windows = written(items.select("item", "text").mapInArrow(_item_windows, "h long, item long, need long, width int"), "item-windows")
        # Lengths of items of fewer than five tokens: a handful of small numbers.
        widths = sorted(r.width for r in windows.filter("width <> 0").select("width").distinct().collect())
        texts = docs.select(*_text_keys(text), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        hashed = texts.mapInArrow(_text_windows([w for w in widths if w > 0], -1 in widths), "k1 long, k2 int, hashes array<long>")
        # A number for each row, so that rows that repeat a text are counted apart; any numbering will do.
        each = hashed.withColumn("copy", F.monotonically_increasing_id()).select("k1", "k2", "copy", F.explode("hashes").alias("h"))
        met = each.join(counted(windows.drop("width")), "h").groupBy("k1", "k2", "copy", "item", "need").agg(F.count("*").alias("n")).filter("n >= need")
        pairs = written(met.select("k1", "k2", "item").distinct(), "leak-candidates")
        size = pairs.groupBy("k1", "k2").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        dealt = pairs.join(size, ["k1", "k2"]).withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("chunks")))
        asked = dealt.join(items, "item").groupBy("k1", "k2", "chunk").agg(F.collect_list(F.struct("id", "text")).alias("items"))
        few = counted(written(pairs.select("k1", "k2").distinct(), "candidate-texts"))
        wanted = written(texts.join(few, ["k1", "k2"]).dropDuplicates(["k1", "k2"]), "candidates")
        told = wanted.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "items").mapInArrow(_compare, "k1 long, k2 int, ids array<long>, share double")
        each = told.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"), F.max("share").alias("share"))
        return written(each, "leaks", keep=True)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text="text", **how) -> DataFrame:
    """The ``keep`` columns, items (ids that leak, sorted), share (the largest share of an item's windows) and contaminated."""
    found = leaks(docs, benchmark, text, **how)
    found = F.broadcast(found) if found.count() <= BROADCAST_WINDOWS // 16 else found
    names = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *_text_keys(text)).join(found, ["k1", "k2"], "left")
    items, share = F.coalesce("items", F.array().cast("array<bigint>")), F.coalesce("share", F.lit(0.0))
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], items.alias("items"), share.alias("share"), (share > 0).alias("contaminated"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text="text", **how) -> DataFrame:
    """The rows of ``docs`` that no item leaks into, with the columns of ``docs``."""
    found = leaks(docs, benchmark, text, **how).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    found = F.broadcast(found) if found.count() <= BROADCAST_WINDOWS else found
    k1, k2 = _text_keys(text)
    return docs.join(found, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")
