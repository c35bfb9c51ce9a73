"""The training-data operators against brute force, on small planted tables and the smallest test data."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weirflow.llm import chunks, components, decontam, exact_dedup, mixing, minhash, sharding, suffix, toxicity, warc, wrapper
from weirflow.llm.kernel import BLOCK

SF = "/root/testdata/sf0.001"
random.seed(5)
WORDS = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mü"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


BASE = prose(120, 1)
LONG = prose(60_000, 2)
TEXTS = [
    (1, BASE), (2, BASE.upper()), (3, BASE + " one more"), (4, None), (5, ""), (6, " \t\n"), (7, "two words"), (8, "Two  words"),
    (9, prose(90, 3) + " " + BASE), (10, LONG), (11, LONG + " end"), (12, prose(40, 4)), (12, prose(40, 4)), (None, prose(40, 5)), (None, None),
    (13, "x" * 300), (14, "y" + "x" * 280), (15, "é" * 80), (16, "a b c d"), (17, "a b c d e"), (18, "A B C D E"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s" if k % 3 else None, k, k) for k, (i, t) in enumerate(TEXTS)], "doc_id long, text string, source string, id long, node long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key_text(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1 mixing


def test_targets_by_repeated_resharing(spark):
    sizes = [("a", 100), ("b", 5), ("c", 1000), ("d", 30), (None, 77), ("e", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    names = sorted((s for s, _ in sizes if s is not None)) + [None]
    weight, size = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, dict(sizes)
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), set(names)
    while left > 1e-9 and free:
        total, step, left = sum(weight[s] for s in free), left, 0.0
        for s in list(free):
            target[s] += step * weight[s] / total
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                free.discard(s)
    assert {s: pytest.approx(t) for s, t in target.items()} == got


def test_mix(spark, docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(TEXTS) and mixing.mix_sources(none).count() == 0
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got)
    assert Counter(r.size for r in got) == Counter(len((t or "").split()) for _, t in TEXTS)
    rows = real(spark)
    first, again = (sorted(map(tuple, mixing.mix_sources(d).collect())) for d in (rows, rows.repartition(7)))
    assert first == again
    per = defaultdict(list)
    source = {r.doc_id: r.source for r in rows.select("doc_id", "source").collect()}
    for r in mixing.mix_sources(rows).collect():
        per[source[r.doc_id]].append(r)
    for mine in per.values():
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1e-6


def test_rounding_keeps_probabilities(spark):
    rows = [(i, 10 + i % 7, 0, 1, 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, size long, base long, sid long, p double")
    taken = [sum(r.p for r in mixing.round_copies(df, seed=s).collect()) for s in range(3)]
    assert all(abs(t - 120) < 15 for t in taken)


def test_many_repeated_rows_are_many_groups(spark):
    """One id and size on a third of the rows: copies come near the target and reruns agree."""
    rows = [(7, "five words are in here", "s")] * 3000 + [(k, "w " * (1 + k % 9), "s") for k in range(100, 3000)] + [(k, "x y", None) for k in range(4000, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    for target in {r.target for r in got}:
        mine = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in mine) - target) <= 5


@pytest.mark.parametrize("most", [mixing.BROADCAST_COPIES, 0])
def test_mixed_documents(spark, docs, none, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_COPIES", most)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and mixing.mixed_documents(none).count() == 0
    assert out.count() == sum(r.copies for r in mixing.mix_sources(docs).collect())


# 2 sharding


def brute_shards(rows, limit):
    h = lambda i, t: int(hashlib.md5(str(i).encode() if i is not None else b"null:" + hashlib.md5((t or "").encode()).hexdigest().encode()).hexdigest()[:15], 16)
    todo, out = [("", [(h(i, t), i, len((t or "").encode())) for i, t in rows])], []
    while todo:
        prefix, mine = todo.pop()
        if not mine:
            continue
        size = sum(b for *_, b in mine)
        if size <= limit or len(mine) == 1 or len(prefix) == sharding.BITS:
            out += [(i, b, prefix, size) for _, i, b in mine]
            continue
        bit = sharding.BITS - len(prefix) - 1
        todo += [(prefix + str(v), [x for x in mine if x[0] >> bit & 1 == v]) for v in (0, 1)]
    return out


@pytest.mark.parametrize("limit", [1, 3000, 20_000, 10**9])
def test_shards(spark, docs, none, limit):
    order = lambda rows: sorted(rows, key=repr)
    got = [(r.doc_id, r.n_bytes, r.shard, r.shard_bytes) for r in sharding.shard(real(spark), limit=limit).collect()]
    assert order(got) == order(brute_shards(key_text(real(spark)), limit))
    mine = sharding.shard(docs, limit=limit)
    assert order((r.doc_id, r.n_bytes, r.shard, r.shard_bytes) for r in mine.collect()) == order(brute_shards(TEXTS, limit))
    assert sharding.shard(none, limit=limit).count() == 0 and "node" in mine.columns


# 3 decontamination


def test_templates_catch_other_numbers_and_names(spark):
    item = "yesterday Alice Smith bought 3 kg of apples and then Alice Smith sold 2 kg of them to Bob for 10 dollars in all"
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (3, ""), (4, prose(30, 8))], "item_id long, text string")
    rows = [
        (1, "before it " + item + " and after"), (2, item.replace("Alice Smith", "Carol").replace("3", "17").replace("kg", "lbs")), (3, item.replace("then Alice Smith", "then Dave").replace("2 kg", "3 kg")),
        (4, "short one"), (5, "a short one"), (6, None), (7, ""), (8, prose(400, 9)), (9, "so " + prose(30, 8)), (10, " ".join(prose(30, 8).split()[:20])), (11, LONG + " " + item),
    ]
    got = {r.doc_id: r.items for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {k for k, v in got.items() if v} == {1, 2, 4, 9, 11} and got[2] == [1] and got[4] == [2] and got[9] == [4]
    joined = {r.doc_id: r.items for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, most=0).collect()}
    assert joined == got


def test_dense_items_with_other_numbers(spark, monkeypatch):
    item = "Tom paid 12 dollars, Ann 15 dollars, Bob 9 dollars and Eve 4 dollars total"
    rows = [
        (1, "Tom paid 13 dollars, Sue 18 dollars, Jim 7 dollars and Kim 5 dollars total"), (2, "so it was said that Tom paid 1 kg, Sue 2 kg, Jim 3 kg and Kim 4 kg total, and more of it"),
        (3, "Tom paid 12 dollars, Ann 15 dollars, Bob 9 dollars"), (4, "Tom paid 1 kg, Sue 2 lbs, Jim 3 miles and Kim 4 cm total"), (5, "all in all 3 kg, Sue 4 kg, Jim 5 kg, Ann 6 kg, Bob 7 kg, Kim 8 kg"), (6, "no numbers here and nothing of the item in it"),
    ]
    bench = spark.createDataFrame([(1, item), (2, "1 2 3 4 5 6 7 8 9")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (decontam.COMPARED, 1):
        monkeypatch.setattr(decontam, "COMPARED", size)
        assert {r.doc_id for r in decontam.contamination(docs, bench).filter("contaminated").collect()} == {1, 2}


def test_short_items_inside_longer_texts(spark):
    bench = spark.createDataFrame([(1, "who wrote Hamlet?"), (2, "short one"), (3, "Ada King Byron Lovelace Noel Gordon Lamb"), (4, "?")], "item_id long, text string")
    rows = [(1, "they asked: who wrote Hamlet? nobody knew"), (2, "who then wrote Hamlet"), (3, "a short one"), (4, "so Ada King Byron Lovelace Noel Gordon Lamb it was"), (5, "Ada King Byron Lovelace Noel Gordon"), (6, "who wrote"), (7, "Hamlet?"), (8, "")]
    got = {r.doc_id: r.items for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {k: v for k, v in got.items() if v} == {1: [1], 4: [3]}


def test_decontamination_edges(spark, docs, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.without_leaks(docs, bench).columns == docs.columns
    texts, items = key_text(real(spark)), [r.text for r in bench.collect()]
    leaked = {i for i, t in texts if any(x in t for x in items)}
    got = {r.doc_id for r in decontam.contamination(real(spark), bench).filter("contaminated").collect()}
    assert leaked and leaked <= got and len(got - leaked) <= 2


def brute_tokens(text):
    """(kind, value) of each token by the docstring's rules, a word at a time."""
    out, opens, before = [], True, None
    units = set(decontam.UNITS)
    for line in (text or "").split("\n"):
        opens = True
        for w in line.split():
            core = "".join(c for c in w if (c.isalnum() and c.isascii()) or ord(c) > 127)
            if not core:
                opens = opens or w[-1] in ".!?:"
                continue
            low = "".join(c.lower() if c.isascii() else c for c in core)
            if any(c in "0123456789" for c in core):
                kind = "number"
            elif before == "number" and low in units:
                kind = "unit"
            elif not opens and ("A" <= core[0] <= "Z") and any("a" <= c <= "z" for c in w):
                kind = "name"
            else:
                kind = "word"
            if kind == "name" and before == "name":
                out[-1] = ("name", out[-1][1] + (low,))
            else:
                out.append((kind, (low,)))
            before, opens = kind, w[-1] in ".!?:"
    return out


def brute_leak(text, item):
    """Whether an item of five tokens or more leaks by its windows, comparing every alignment; placeholders take the value most of their tokens have."""
    t, q = brute_tokens(text), brute_tokens(item)
    n = len(q) - 4
    same = lambda a, b: a[0] == b[0] and (a[0] != "word" or a[1] == b[1])
    strict, loose = set(), set()
    for shift in range(-len(q), len(t)):
        hits = [k for k in range(n) if 0 <= k + shift and k + shift + 5 <= len(t) and all(same(t[k + shift + j], q[k + j]) for j in range(5))]
        literal = lambda k: sum(q[k + j][0] == "word" for j in range(5))
        exact = [k for k in hits if literal(k) >= 2 or all(t[k + shift + j][1] == q[k + j][1] for j in range(5))]
        for mine, into, ok in ((exact, strict, True), (hits, loose, any(literal(k) for k in hits))):
            votes = defaultdict(Counter)
            for i in {k + j for k in mine for j in range(5)}:
                if q[i][0] != "word":
                    votes[q[i]][t[i + shift][1]] += 1
            tied = any(len(v) > 1 and len({c for _, c in v.most_common(2)}) == 1 for v in votes.values())
            if tied:
                return None  # which value is the smallest is the hash's to say
            if ok:
                into |= {k for k in mine if all(q[k + j][0] == "word" or votes[q[k + j]].most_common(1)[0][0] == t[k + j + shift][1] for j in range(5))}
    words = {k + j for k in loose for j in range(5) if q[k + j][0] == "word"}
    return len(strict) >= 0.75 * n or (len(loose) >= 0.75 * n and len(words) >= 3)


def test_leaks_by_brute_force(spark):
    r = random.Random(12)
    nouns, names = ["apples", "pears", "boxes", "trains", "letters"], ["Ann", "Bob", "Carol", "Dave", "Eve"]

    def story(r):
        a, b = r.sample(names, 2)
        x, y, u = r.randrange(2, 99), r.randrange(100, 999), r.choice(["kg", "miles", "dollars"])
        return f"yesterday {a} bought {x} {u} of {r.choice(nouns)} and then {a} gave {y} {r.choice(nouns)} to {b} because {b} had only {x} {u} left over from {r.choice(nouns)}"

    items = [(k, story(random.Random(k))) for k in range(12)] + [(20 + k, " ".join(random.Random(400 + k).choices(WORDS[2:], k=9 + k))) for k in range(6)]
    rows = []
    for k in range(120):
        base = story(random.Random(k % 20)) if k % 3 else items[12 + k % 6][1]
        words = base.split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = f"changed{'abc'[r.randrange(3)]}"
        rows.append((k, " ".join([*prose(r.randrange(6), k).split(), *words, "and", "more"])))
    want = {}
    for i, t in rows:
        want[i] = {k: brute_leak(t, x) for k, x in items}
    got = {x.doc_id: x.items for x in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    known = [(i, k, leak) for i, of in want.items() for k, leak in of.items() if leak is not None]
    assert sum(leak for *_, leak in known) > 40 and len(known) > 0.9 * sum(map(len, want.values()))
    assert [(i, k) for i, k, leak in known if leak != (k in got[i])] == []


# 4 exact dedup


def low(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("budget", [exact_dedup.TRIE_BYTES, 1])
def test_exact(spark, docs, none, budget):
    for df, rows in ((docs, TEXTS), (real(spark), key_text(real(spark)))):
        groups = defaultdict(list)
        for i, t in rows:
            groups[low(t)].append(i)
        want = []
        for i, t in rows:
            ids = [x for x in groups[low(t)] if x is not None]
            keep = max(ids) if ids else None
            want.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t)).hexdigest()))
        got = [tuple(r) for r in exact_dedup.exact_dedup(df, budget=budget).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_trie():
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(9))) for _ in range(500)]
    trie = exact_dedup.PatriciaTrie()
    for k, t in enumerate(texts):
        trie.insert(t, k)
    assert list(trie.terminals()) == sorted((t, texts.index(t), texts.count(t)) for t in set(texts))
    trie, out = exact_dedup.PatriciaTrie(budget=3), []
    for t in sorted(texts):
        trie.insert(t, 0)
        out += trie.spill(t)
    out += trie.terminals()
    assert sorted((t, n) for t, _, n in out) == sorted((t, texts.count(t)) for t in set(texts))


# 5 MinHash


def shingle_set(t):
    w = low(t).split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_groups(sets):
    """The component of each set, by comparing all pairs."""
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    return [root(k) for k in range(len(sets))]


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    roots = brute_groups([s for _, s in sets])
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[roots[k]].append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [v for v in least[roots[k]] if v is not None]
        c = min(ids) if ids and s else i
        out.append((i, len(s), c, i == c))
    return out


def near_rows(n, seed):
    """Copies of one text with more and more words changed: similarities around the threshold."""
    r, words = random.Random(seed), prose(150, seed).split()
    out = []
    for k in range(n):
        mine = list(words)
        for _ in range(r.randrange(9)):
            mine[r.randrange(len(mine))] = f"w{r.randrange(10**6)}"
        out.append((1000 * seed + k, " ".join(mine)))
    return out


def test_near_duplicates(spark, docs, none):
    for df, rows in ((docs, TEXTS), (real(spark), key_text(real(spark))), (None, near_rows(60, 1) + near_rows(40, 2) + [(7, "a b c d e f g h"), (8, "a b c d e f g"), (9, "a b c d e f g h i j")])):
        df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
        assert sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr) == sorted(brute_components(rows), key=repr)
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.without_near_duplicates(docs).columns == docs.columns


def test_null_ids_with_near_copies(spark):
    def text(seed, change):
        words = prose(120, seed).split()
        return " ".join([*words[:60], change, *words[61:]])

    rows = [(None if k % 2 == side else 2 * seed + side, text(seed, f"w{k}")) for seed in range(50, 62) for side in (0, 1) for k in (0, 1)]
    rows += [(None, text(70, "a")), (None, text(70, "b")), (None, text(71, "c")), (None, "no copy of it anywhere else"), (900, text(72, "e")), (None, text(72, "e"))]
    # Whether the null id is hub or member lies with the digests: both occur among so many pairs.
    rows += [(1000 + k, text(80 + k, "x")) for k in range(8)] + [(None, text(80 + k, "y")) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr) == sorted(want, key=repr)
    assert_one_each(rows, key_text(minhash.without_near_duplicates(df)))


def assert_one_each(rows, kept):
    """Of each component exactly one row is left, that of the smallest id; rows without words all stay."""
    groups = defaultdict(list)
    for row, c in zip(rows, brute_groups([shingle_set(t) for _, t in rows]), strict=True):
        groups[c].append(row)
    left = Counter(kept)
    for mine in groups.values():
        if not shingle_set(mine[0][1]):
            continue
        ids = [i for i, _ in mine if i is not None]
        found = [r for r in dict.fromkeys(mine) for _ in range(left.pop(r, 0))]
        assert len(found) == 1 and found[0][0] == (min(ids) if ids else None)
    assert left == Counter(r for r in rows if not shingle_set(r[1]))


def test_one_id_on_several_texts(spark):
    """Ids rank rows and do not join them: one id on different texts, and its near copies under other ids, null ids among them."""
    rows = [(2, prose(60, 5)), (2, prose(60, 6)), (1, prose(60, 6) + " end"), (3, prose(60, 5) + " end"), (2, prose(60, 7)), (2, prose(60, 7)), (None, prose(60, 7) + " end"), (None, prose(60, 8)), (None, prose(60, 8)), (5, "a b"), (5, "a b"), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr) == sorted(brute_components(rows), key=repr)
    assert_one_each(rows, key_text(minhash.without_near_duplicates(df)))


def test_sets_that_share_half_a_digest(spark, monkeypatch):
    """Names of nodes of 4 bits only: sets that share a name are told apart by the rest of the digest."""
    whole = minhash.digest
    monkeypatch.setattr(minhash, "digest", lambda s: (whole(s)[0] % 16, whole(s)[1]) if len(s) else (None, None))
    rows = near_rows(12, 3) + [(100 + k, prose(40, 200 + k)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == sorted(brute_components(rows))


def test_open_buckets_take_several_rounds(spark, monkeypatch):
    """Many texts around one passage, few of them similar: every pair of a bucket is tried in the end."""
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "STEP", 2)
    passage, rows = prose(100, 31), []
    for k in range(60):
        own = prose(28, 300 + k // 2).split()
        rows.append((k, " ".join([passage, *own[: 20 + 4 * (k % 2)]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == sorted(brute_components(rows))


def rows_made(spark, since, *words):
    """Rows that the plan nodes whose description has all ``words`` made in executions from number ``since`` on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in (runs.apply(j).executionId() for j in range(runs.size())):
        if k < since:
            continue
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if all(w in node.desc() for w in words):
                for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_rounds_hold_each_entry_to_the_open_buckets_once(spark, monkeypatch):
    """However many rounds there are, an entry is joined with the open buckets at their start and when it is a hub."""
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "STEP", 2)
    tables, whole = defaultdict(list), minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name="table", **more: tables[name].append(whole(df, name, **more).localCheckpoint()) or tables[name][-1])
    passage, rows = prose(100, 31), []
    for k in range(60):
        own = prose(28, 300 + k // 2).split()
        rows.append((k, " ".join([passage, *own[: 20 + 4 * (k % 2)]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == sorted(brute_components(rows))
    entries = tables["open"][0].count()
    assert len(tables["rest"]) > 3 and 0 < rows_made(spark, since, "bucket", "LeftSemi") <= 2 * entries


def test_bands_and_texts_are_shuffled_no_more_than_needed(spark, monkeypatch):
    """Bands stay where they were made; a text is sent to the hubs that it is compared with, in one exchange."""
    plans, whole = defaultdict(list), minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name="table", **more: plans[name].append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, name, **more))
    rows = near_rows(30, 4) + [(k, prose(30, 400 + k)) for k in range(5)]
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))
    assert plans["confirmed"] and all(p.count("Exchange hashpartitioning") == 1 for p in plans["confirmed"])
    assert all("bands" not in p for p in plans["nodes"]) and all("Exchange hashpartitioning" not in p for p in plans["node-texts"])


def around_a_passage(n):
    """Texts around one passage: two and two are similar, and a few more by chance."""
    passage = prose(100, 31).split()
    owns = [prose(28, 300 + k // 2).split() for k in range(n)]
    return [(k, " ".join([*passage, *own[: 20 + 4 * (k % 2)]])) for k, own in enumerate(owns)]


def test_a_round_has_two_exchanges(spark, monkeypatch):
    """A round of hubs shuffles its entries and the texts that it compares once each, and nothing else."""
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "STEP", 2)
    plans, whole = [], minhash.written

    def kept(df, name="table", **more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return whole(df, name, **more)

    monkeypatch.setattr(minhash, "written", kept)
    monkeypatch.setattr(components, "written", kept)
    rows = around_a_passage(60)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))
    names = [name for name, _ in plans]
    rounds = plans[names.index("rest") : names.index("judged")]
    assert names.count("rest") > 3 and all(n == 1 for name, n in rounds if name in ("rest", "confirmed"))
    assert not any(n for name, n in rounds if name not in ("rest", "confirmed"))


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    """Buckets of many more nodes than a block holds: the result and the pairs are those of one block."""
    pairs, whole = defaultdict(list), minhash.written
    rows = around_a_passage(60) + [(1000 + i, t) for i, t in near_rows(40, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (minhash.BLOCK, 7):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "written", lambda df, name="table", b=block, **more: (out := whole(df, name, **more), name == "rest" and pairs[b].append(sorted((r.hub, r.node) for r in out.collect() if r.node is not None)))[0])
        assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == sorted(brute_components(rows))
    one, several = pairs.values()
    assert one == several and any(one) and all(len(set(p)) == len(p) for p in one)


def test_near_duplicates_beyond_the_broadcasts(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_NODES", 0)
    repeated = [(5, prose(60, 6)), (5, prose(60, 6)), (5, prose(60, 6)), (4, prose(60, 6) + " end"), (None, prose(60, 6)), (None, prose(60, 6))]
    for rows in (TEXTS, near_rows(40, 2) + near_rows(40, 2)[:9] + repeated):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr) == sorted(brute_components(rows), key=repr)
        assert_one_each(rows, key_text(minhash.without_near_duplicates(df)))


def test_components(spark, monkeypatch):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame(edges, "u long, v long")
    one = sorted(map(tuple, components.components(df).collect()))
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert sorted(map(tuple, components.components(df).collect())) == one
    assert dict(one)[460] == 400


# 6 WARC


def test_warc(spark):
    html = ["<p>é</p>", "<p>é</p>", "", None, "a\r\n\r\nWARC/1.1\r\n\r\nb", "z" * 300_000, "<p>é</p>", "<p>é</p>"]
    ids = [5, 3, 9, 4, 1, 2, 3, None]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i} x\n", h, "r") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, record_id string")
    captures = warc.round_trip(pages).cache()
    first = defaultdict(lambda: None)
    for i, h in zip(ids, html, strict=True):
        if i is not None:
            first[h or ""] = max(i, first[h or ""]) if first[h or ""] is not None else i
    want = []
    for i, h in zip(ids, html, strict=True):
        raw, f = (h or "").encode(), first[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    assert sorted(map(tuple, warc.capture_digests(captures).collect()), key=repr) == sorted(want, key=repr)
    assert captures.filter("request IS NULL OR metadata IS NULL").count() == 0
    got = {bytes(r.p).decode() for r in captures.filter("response.kind = 'response'").select(F.col("response.payload").alias("p")).collect()}
    assert got == {h or "" for h in html}
    assert warc.round_trip(pages.limit(0)).count() == 0
    least = warc.capture_digests(warc.round_trip(pages, least=100)).filter("record_type = 'revisit'").count()
    assert least == 0


# 7 toxicity


def test_toxicity_on_held_out_labels(spark, docs, none):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labels.filter("doc_id % 4 = 0")
    chain = toxicity.train(rows, labels.filter("doc_id % 4 <> 0"))
    assert [name for name, _ in chain] == list(toxicity.CHAIN)
    told = toxicity.score(rows, chain).select("doc_id", F.col("toxic").alias("said")).join(held, "doc_id").groupBy("said", "toxic").count().collect()
    n = {(r.said, r.toxic): r["count"] for r in told}
    assert n[True, 1] / (n[True, 1] + n.get((True, 0), 0)) > 0.95
    assert n[True, 1] / (n[True, 1] + n[False, 1]) > 0.65  # a third of the toxic labels have no word that tells
    assert toxicity.score(docs, chain).count() == len(TEXTS) and toxicity.score(none, chain).count() == 0
    assert toxicity.without_toxic(docs, chain).columns == docs.columns


def test_chain_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).filter("toxic").count() == 0


# 8 chunks


def test_chunks_resist_insertions():
    import numpy as np

    def cuts(raw):
        start, end = chunks.cut_points(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [raw[a:b] for a, b in zip(start, end, strict=True)]

    raw = prose(2000, 6).encode()
    whole, shifted = cuts(raw), cuts(b"inserted text " + raw)
    assert b"".join(whole) == raw and len(set(whole) - set(shifted)) <= 2
    assert max(map(len, cuts(b"q" * 5000))) <= chunks.MOST


def test_passages_of_fifty_words_hold_whole_chunks(spark):
    r = random.Random(21)
    passages = [" ".join("".join(r.choice("abcdeiorstü") for _ in range(r.randrange(2, 9))) for _ in range(51)) for _ in range(300)] + ["eneinä " * 51, "the " * 51]
    rows = [(2 * k + c, f"{prose(30 + k % 7, 900 + 2 * k + c)} {p} {prose(30, 2900 + 2 * k + c)}") for k, p in enumerate(passages) for c in (0, 1)]
    got = {x.doc_id: x.n_removed for x in chunks.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k + 1] > 0 for k in range(len(passages)))
    assert sum(got[2 * k + 1] for k in range(len(passages))) > 0.65 * sum(len(p.encode()) for p in passages)


def brute_cuts(raw):
    """The chunks of one text, from the docstring's rules and the gear table alone, a byte at a time."""
    n, least, gear = len(raw), chunks.LEAST, chunks._GEAR.tolist()
    h = [sum(gear[raw[k - j]] << j for j in range(min(16, k + 1))) % 2**32 for k in range(n)]
    cuts, last = [], 0
    for k in range(n):
        if k + 1 < least or n - k - 1 < least or k + 1 == n:
            continue
        around = h[max(0, k - least) : k] + h[k + 1 : k + 1 + least]
        if all(h[k] <= x for x in around) and k + 1 - last >= least:
            cuts.append(k + 1)
            last = k + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        out += [(x, raw[x : min(x + chunks.MOST, b)]) for x in range(a, b, chunks.MOST)]
    return out


def test_cuts_by_brute_force():
    import numpy as np

    r = random.Random(4)
    raws = [prose(n, n).encode() for n in (1, 3, 9, 40, 200)] + [b"q" * 3000, b"ab" * 700, bytes(r.randrange(256) for _ in range(2000)), "ü".encode() * 90]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raws])])
    start, end = chunks.cut_points(np.frombuffer(b"".join(raws), np.uint8), offs)
    want = [(int(o) + a, int(o) + a + len(p)) for o, x in zip(offs, raws, strict=False) for a, p in brute_cuts(x)]
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == want


REPEATED = [(1, prose(80, 41)), (1, prose(80, 42)), (1, prose(50, 41) + " x"), (2, prose(80, 42) + " y"), (None, prose(80, 43)), (None, prose(80, 44) + " " + prose(80, 43)), (None, prose(80, 42)), (3, prose(80, 44)), (3, prose(80, 44))]


def test_substring_dedup(spark, docs, none):
    import numpy as np

    for df, rows in ((docs, TEXTS), (real(spark), key_text(real(spark))), (None, REPEATED)):
        df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
        keys = {(r.doc_id, r.text): r.k for r in df.select("doc_id", "text", chunks.row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
        cut = []
        for i, t in rows:
            raw = (t or "").encode()
            if len(raw) < 20_000:
                pieces = brute_cuts(raw)
            else:  # too long for one byte at a time
                start, end = chunks.cut_points(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                pieces = [(int(a), raw[a:b]) for a, b in zip(start, end, strict=True)]
            cut.append((i, (2**63 - 1 if i is None else i, keys[i, t]), raw, pieces))
        owner = {}
        for _, rank, _, pieces in cut:
            for _, p in pieces:
                owner[p] = min(rank, owner.get(p, rank))
        want, kept, held = [], [], set()
        for i, rank, raw, pieces in cut:
            seen, gone, left = set(), [], b""
            for a, p in pieces:
                if p in seen or owner[p] < rank:
                    gone.append((a, len(p)))
                else:
                    left += p
                    held.add(p)
                seen.add(p)
            want.append((i, len(raw), len(pieces), len(gone), sum(n for _, n in gone), tuple(gone)))
            kept.append((i, left.decode("utf-8", "ignore")))
        # Nothing is removed that no row holds.
        assert all(p in held for *_, pieces in cut for _, p in pieces)
        got = [(*tuple(r)[:5], tuple(tuple(s) for s in r.spans)) for r in chunks.substring_dedup(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert sorted(map(tuple, chunks.deduplicated_texts(df).collect()), key=repr) == sorted(kept, key=repr)
    assert chunks.substring_dedup(none).count() == 0


# 9 wrapper


PAGE = '<html><head><title>t</title></head><body class="has-sidebar"><div id="topbar">Menu here</div><div class="wrap"><div class="crumbs7">Home</div><div class="post">{body}</div><div class="note">All rights kept by us</div></div><div class="comments"><p>first!</p></div><script>var a="<p>no</p>";</script></body></html>'


def test_wrapper(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(body=f"<h1>Title {k}</h1><p>Some <b>bold</b>\n text &amp; more {k}<br>line<p>second &lt;{k}&gt; paragraph that goes on")) for k in range(5)]
    rows += [(10, None, None), (11, "x", ""), (12, "http://o/", "<article><header><h2>H</h2></header><p>a<aside>no</aside></p><div class='ad'>buy</div><footer>f</footer></article><footer>z</footer>"), (13, "http://o/", "no markup <b>at all"), (12, "http://o/", "<p>twice"), (14, "http://o/", "<p>" + "long " * 200_000)]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = defaultdict(list)
    for r in wrapper.extract(pages).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    for k in range(5):
        assert got[k] == [f"Title {k}\n\nSome bold text & more {k} line\n\nsecond <{k}> paragraph that goes on"]
    assert got[10] == got[11] == [""] and sorted(got[12]) == ["H\n\na", "twice"] and got[13] == ["no markup at all"] and len(got[14][0]) == 999_999
    assert wrapper.extract(pages.limit(0)).count() == 0


def test_wrapper_joined_by_host(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(tuple, wrapper.extract(pages).collect()))
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, wrapper.extract(pages).collect())) == want


ARTICLE = "<html><body><article><h1>Title {k}</h1><p>first {k}</p>{a}<p>Read <a href='/x'>our letter</a> every week</p>{b}<p>last {k}</p></article></body></html>"


def test_template_blocks_inside_articles(spark):
    rows = [(k, f"http://h/{k}", ARTICLE.format(k=k, a=f"<p>more {k}</p>" * (k % 3), b=f"<p>yet more {k}</p>" * (k % 2))) for k in range(6)]
    rows += [(10 + k, "http://same/", "<main><p>one text</p><p>of two</p></main>") for k in range(4)] + [(20 + k, "http://two/", f"<article><p>kept here</p><p>{k}</p></article>") for k in range(2)]
    for df in (spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(rows[::-1], "page_id long, url string, html string").repartition(5)):
        got = {r.page_id: r.text.split("\n\n") for r in wrapper.extract(df).collect()}
        for k in range(6):
            assert got[k] == [f"Title {k}", f"first {k}", *[f"more {k}"] * (k % 3), *[f"yet more {k}"] * (k % 2), f"last {k}"]
        assert all(got[10 + k] == ["one text", "of two"] for k in range(4)) and got[20] == ["kept here", "0"]


def random_tree(r, depth=3):
    inner = [random_tree(r, depth - 1) for _ in range(r.randrange(4))] if depth else []
    return (r.choice("abc"), inner or [r.choice(["x", "y", "z"])])


def tree_html(tree):
    return f"<div class='{tree[0]}'>" + "".join(c if isinstance(c, str) else tree_html(c) for c in tree[1]) + "</div>"


def matching(t, page, i=0, j=0):
    """Simple tree matching by its recursion, on the same nodes."""
    if t.key[i] != page.key[j]:
        return 0
    a, b = t.kids[i], page.kids[j]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(1, len(a) + 1):
        for y in range(1, len(b) + 1):
            best[x][y] = max(best[x - 1][y], best[x][y - 1], best[x - 1][y - 1] + matching(t, page, a[x - 1], b[y - 1]))
    return 1 + best[-1][-1]


def test_alignment_by_brute_force():
    r = random.Random(17)
    for _ in range(150):
        one, two = (wrapper.Page(wrapper.parse(tree_html(random_tree(r)))) for _ in range(2))
        t = wrapper.Template(wrapper.template_of(one, frozenset(one.signs())))
        size, matched = wrapper.align(t, two)
        assert size == len(matched) == matching(t, two)
        assert wrapper.align(t, one) == (len(one.key), set(range(len(one.key))))


def test_template_decides_and_rules_keep_the_rest(spark):
    """The template alone takes what carries no telltale class; a constant text out of its place stays; article text of any element stays."""
    page = "<html><body><article><p>Share this with a friend</p><h1>T{k}</h1><p class='related-work'>Others did {k}</p><div class='search-results'>found {k}</div><p>Area is <math><mi>x</mi></math> units {k}</p>{quote}<div class='z'>Written with love</div></article><article><p>second {k}</p></article></body></html>"
    rows = [(k, f"http://h/{k}", page.format(k=k, quote="<blockquote><p>Written with love</p></blockquote>" if k == 3 else "")) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in wrapper.extract(pages).collect()}
    for k in range(6):
        assert got[k] == [f"T{k}", f"Others did {k}", f"found {k}", f"Area is x units {k}", *["Written with love"] * (k == 3), f"second {k}"]
    alone = wrapper.main_text(rows[0][2])
    assert alone.startswith("Share this") and "Written with love" in alone


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 10_000 + "<p>deep {k}</p><p>same words</p>" + "</div>" * 10_000
    wide = "<main>" + "<p>w{k}</p>" * 5000 + "<p>the end</p></main>"
    rows = [(k, "http://deep/", deep.replace("{k}", str(k))) for k in range(4)] + [(10 + k, "http://wide/", wide.replace("{k}", str(k))) for k in range(4)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"deep {k}" for k in range(4)) and all(got[10 + k] == "\n\n".join([f"w{k}"] * 5000) for k in range(4))


# 10 suffixes


def brute_removed(rows):
    rank = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k : k + 50]
            first[w] = min(first.get(w, 2**63), rank(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < rank(i):
                mark[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        spans = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [suffix.BUCKET_BYTES, 20_000])
def test_suffixes(spark, docs, none, monkeypatch, bucket):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket)
    r = random.Random(11)
    tricky = [(k, "".join(r.choice("ab") for _ in range(r.randrange(400)))) for k in range(40)] + [(50 + k, "ab" * r.randrange(120) + "c" * r.randrange(3)) for k in range(20)]
    small = [(i, t if t is None or len(t) < BLOCK // 16 else t[:70_000]) for i, t in TEXTS]
    for rows in (small, tricky, key_text(real(spark))):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [tuple(x)[:5] for x in suffix.suffix_dedup(df).collect()]
        assert sorted(got, key=repr) == sorted(brute_removed(rows), key=repr)
    assert suffix.suffix_dedup(none).count() == 0


def test_one_suffix_in_every_text_and_long_texts(spark, monkeypatch):
    """A line that all texts share amid other words, rows that repeat, and texts of over one block and of several arrow batches."""
    monkeypatch.setattr(suffix, "PARTITIONS", 2)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 30_000)
    line = " read the whole of this line in each and every one of the texts of this table "
    long = prose(40_000, 77)
    rows = [(k, prose(8 + k % 5, 5000 + k) + line + prose(7, 6000 + k)) for k in range(150)] + [(7, "twice " + line)] * 3
    rows += [(200, long), (201, "x" + long[: BLOCK + 5000] + " end"), (202, prose(30, 78) + long[1000:1400])]
    got = [tuple(x)[:5] for x in suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted(brute_removed(rows))
