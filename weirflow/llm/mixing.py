"""Mixing sources to target weights by Pivotal dependent rounding.

A source whose target is ``f`` times its size wants ``f`` copies of each of its
documents. The whole part of ``f`` is given to all; the fraction is a copy
probability, and rounding settles it. Pairs of documents trade probability
mass, weighted by their sizes so that the expected words stay what they were,
until one of the two is integral; the other goes on as the residual. Residuals
meet in a reduction tree: each level folds groups of about ``fan`` rows of a
source, and one residual of each group goes up a level. Only (id, size,
probability) rows move, a hot source is as many groups as it needs, and the
number of levels is the logarithm of the largest source.

Every document keeps its probability exactly, apart from the one residual at the top
of each source's tree, which is rounded to the nearer side so that the words of
the source differ from its target by half a document at most. Groups are folded
from large documents to small ones, so that the residual tends to be small.

Defined results: null or empty texts have size 0 and take 0 words; a null
source is a source; repeated rows are mixed one by one, each on its own row; an
empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN = 32
#: Up to so many sources the table of targets is broadcast: 40 bytes a row.
BROADCAST_SOURCES = 20_000
#: Up to so many rows that the mix takes, their copies are broadcast, so that no text is shuffled: about 120 bytes each; more are joined.
BROADCAST_COPIES = 500_000
_EPS = 1e-12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """source, source_size -> and target: shares by weight, filled up to ``most`` times each size.

    Sources in order of code points, null last, have ``weights`` in turn. A
    source is full when ``most * size / weight`` is below the level at which the
    rest of the total is shared; taken in that order, one pass of running sums
    finds the level that repeated resharing ends at.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("full_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, rest, everything = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    levels = ranked.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest))
    full = F.col("full_at") <= F.col("level")
    level = F.min_by(F.when(~full, F.col("level")), F.when(~full, F.struct("full_at", F.coalesce("source", F.lit(""))))).over(everything)
    return levels.select("source", "source_size", F.when(full, F.lit(most) * F.col("source_size")).otherwise(F.col("weight") * level).alias("target"))


def _draw(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _fold(rows: Column, seed: int) -> Column:
    """Pivotal rounding along an array of structs (id, size, base, p): the settled rows and the residual."""
    row_type = "struct<id:bigint,size:bigint,base:bigint,sid:bigint,copy:bigint,p:double>"

    def settled(x: Column, p: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("id", "size", "base", "sid", "copy")], p.cast("double").alias("p"))

    def step(acc: Column, x: Column) -> Column:
        i = acc["carry"]
        up = F.least(i["size"] * (1 - i["p"]), x["size"] * x["p"])
        down = F.least(i["size"] * i["p"], x["size"] * (1 - x["p"]))
        rises = _draw(i["id"], x["id"], i["size"], x["size"], i["p"], F.lit(seed)) * (up + down) < down
        move = F.when(rises, up).otherwise(-down)
        first_done = F.when(rises, i["size"] * (1 - i["p"]) <= x["size"] * x["p"]).otherwise(i["size"] * i["p"] <= x["size"] * (1 - x["p"]))
        done = F.when(first_done, settled(i, F.when(rises, 1.0).otherwise(0.0))).otherwise(settled(x, F.when(rises, 0.0).otherwise(1.0)))
        carry = F.when(first_done, settled(x, x["p"] - move / x["size"])).otherwise(settled(i, i["p"] + move / i["size"]))
        return F.when(i.isNull(), F.struct(acc["done"].alias("done"), x.alias("carry"))).otherwise(F.struct(F.concat(acc["done"], F.array(done)).alias("done"), carry.alias("carry")))

    start = F.struct(F.array().cast(f"array<{row_type}>").alias("done"), F.lit(None).cast(row_type).alias("carry"))
    return F.aggregate(rows, start, step, lambda acc: F.concat(acc["done"], F.array(acc["carry"])))


def round_copies(rows: DataFrame, fan: int = FAN, seed: int = 17) -> DataFrame:
    """Rows (id, size, base, sid, p) with every p settled to 0 or 1.

    ``sid`` is the source within which mass may move; ``copy`` (0 where there is none) tells rows that repeat
    id and size apart, so that they do not meet in one group. One level a pass, each
    written before the next reads its residuals.
    """
    rows = rows if "copy" in rows.columns else rows.withColumn("copy", F.lit(0).cast("long"))
    open_row = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS) & (F.col("size") > 0)
    closed = rows.filter(~open_row).withColumn("p", F.when((F.col("p") > 0.5) & (F.col("size") > 0), 1.0).otherwise(0.0))
    level, parts = rows.filter(open_row), [closed]
    for depth in range(64):
        groups = level.groupBy("sid").agg(F.ceil(F.count("*") / fan).alias("groups"))
        most = groups.agg(F.max("groups").alias("n"), F.count("*").alias("sources")).first()
        if not most.n:
            break
        groups = F.broadcast(groups) if most.sources <= BROADCAST_SOURCES else groups
        place = F.xxhash64("id", "size", "copy", F.lit(seed + depth))
        folded = (
            level.join(groups, "sid")
            .withColumn("group", F.pmod(place, F.col("groups")))
            .groupBy("sid", "group")
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("large_first"), F.pmod(F.xxhash64("id", F.lit(~seed)), F.lit(1 << 31)).alias("order"), "id", "size", "base", "sid", "copy", "p"))).alias("rows"))
            .select(F.explode(_fold(F.transform("rows", lambda x: F.struct(*[x[c].alias(c) for c in ("id", "size", "base", "sid", "copy", "p")])), seed)).alias("row"))
            .select("row.*")
        )
        folded = written(folded, "mix-level")
        if most.n == 1:
            parts.append(folded.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
            break
        parts.append(folded.filter(~open_row).withColumn("p", F.when(F.col("p") > 0.5, 1.0).otherwise(0.0)))
        level = folded.filter(open_row)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mix_sources(docs: DataFrame, key="doc_id", text="text", source="source", weights=WEIGHTS, share=SHARE, most=MOST, fan: int = FAN, seed: int = 17) -> DataFrame:
    """(key, size, source_size, target, copies, taken) of each row of ``docs``."""
    rows = written(docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, most).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    side = F.broadcast(targets.withColumnRenamed("source", "name")) if small else targets.withColumnRenamed("source", "name")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Rows that repeat id, size and source are counted, with their counts combined before the shuffle, and numbered.
    numbered = rows.groupBy("id", "size", "source").agg(F.count("*").alias("n")).select("id", "size", "source", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    asked = numbered.join(side, F.col("source").eqNullSafe(F.col("name"))).select("id", "size", F.floor(ratio).alias("base"), "sid", "copy", (ratio - F.floor(ratio)).alias("p"))
    settled = round_copies(asked, fan, seed)
    of = targets.select("sid", "source_size", "target")
    copies = F.col("base") + F.col("p").cast("long")
    return settled.join(F.broadcast(of) if small else of, "sid").select(F.col("id").alias(key), F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    Rows of equal id are told apart by size; those of equal size too take the
    copies of one another, which are the same rows or as good. Rows that the
    mix takes no copy of are left out.
    """
    key = how.get("key", "doc_id")
    asked = mix_sources(docs, **how).groupBy(F.col(key).alias("__id"), F.col("size").alias("__size")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("__of"))
    asked = written(asked.filter(F.element_at("__of", 1) > 0), "mix-copies")
    few = asked.count() <= BROADCAST_COPIES
    size = word_count(F.col(how.get("text", "text")).cast("string"))
    sized = docs.withColumn("__words", size)
    joined = sized.join(F.broadcast(asked) if few else asked, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")))
    # Only ids that repeat have more than one entry; their rows are numbered. Without any, texts are joined once and not sorted.
    if asked.filter(F.size("__of") > 1).limit(1).count():
        rows = joined.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__size").orderBy(F.xxhash64(*[f"`{c}`" for c in docs.columns]))))
    else:
        rows = joined.withColumn("__n", F.lit(1))
    rows = rows.withColumn("__take", F.try_element_at("__of", F.col("__n")))
    copies = F.when(F.col("__take").isNotNull(), F.array_repeat(F.lit(1), F.col("__take").cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("__copy", F.explode(copies)).select([F.col(f"`{c}`") for c in docs.columns])
