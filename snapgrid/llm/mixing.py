"""Mixing sources to target weights by dependent rounding of copy numbers (native).

A source's documents all deserve target / size copies.  The whole part is granted; the fractions are rounded together:
two documents of one source meet, and a random amount of their common mass (in words) moves from one to the other until
one of them is settled at 0 or 1.  The other stays in play.  A source's words therefore stay what they were but for the
last document in play, which is rounded to the nearer side; some small documents then change sides for what that adds or
takes away, as near as their sizes come to it.  Meetings form a tree: groups of about ``FAN`` documents of a
source fold in parallel, and what each leaves over (one document at most) meets ``FAN`` others on the next level, so
a hot source is only a wider tree.  Randomness comes from hashes of the documents, so reruns agree.

Defined cases: a NULL text has size 0; documents of size 0 are rounded alone, by their hash; a NULL source is a source
of its own, last in order; rows that agree in id, source and size are rounded one by one; an empty table, or one without
words, takes nothing; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.llm.common import WORD, materialise, table, text_or_empty

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
FAN = 64
SEED = 20_240
POOL = 128
_EPS = 1e-9


def size_of(text_col: str) -> Column:
    """Number of words, by the gaps between them; 0 for NULL."""
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target): one row per source.

    All targets together are the size of all sources.  With sources in the order of cap / weight, those before some
    point are at their cap, and the rest share what is left by weight; the level of that share is found at the point.
    """
    ranked = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
              .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") - 1) % len(weights) + 1)
    rows = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                           / F.sum("weight").over(onward))
    fits = F.col("cap") >= F.col("level") * F.col("weight")
    rows = rows.withColumn("level", F.max(F.when(fits, F.col("level"))).over(everything))
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) / float(1 << 52)


def _meet(state: Column, other: Column) -> Column:
    """One meeting: ``live`` and ``other`` exchange words until one is settled, which joins ``done``."""
    live = state["live"]
    a, b, p, q = live["size"], other["size"], live["p"], other["p"]
    up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))  # words that can move to live, and away from it
    rises = _uniform(live["key"], other["key"]) * (up + down) < down

    def settled(one, taken, rest, left):
        done = F.concat(state["done"], F.array(F.struct(one["key"].alias("key"), F.lit(taken).alias("up"))))
        kept = F.struct(rest["key"].alias("key"), rest["size"].alias("size"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("p"))
        return F.struct(kept.alias("live"), done.alias("done"))

    gain = (F.when(a * (1 - p) <= b * q, settled(live, 1, other, q - a * (1 - p) / b))
            .otherwise(settled(other, 0, live, p + b * q / a)))
    loss = (F.when(a * p <= b * (1 - q), settled(live, 0, other, q + a * p / b))
            .otherwise(settled(other, 1, live, p - b * (1 - q) / a)))
    return F.when(rises, gain).otherwise(loss)


def _fold(items: DataFrame) -> DataFrame:
    """Per (source, group): what is settled, and what stays in play."""
    listed = items.groupBy("source", "group").agg(
        F.sort_array(F.collect_list(F.struct("size", "key", "p")), asc=False).alias("all"))  # large ones meet first
    start = F.struct(
        F.struct(F.col("all")[0]["key"].alias("key"), F.col("all")[0]["size"].alias("size"),
                 F.col("all")[0]["p"].alias("p")).alias("live"),
        F.filter(F.transform("all", lambda x: F.struct(x["key"].alias("key"), F.lit(0).alias("up"))), lambda x: F.lit(False))
        .alias("done"))
    return listed.select("source", "group", F.aggregate(F.slice("all", 2, F.size("all")), start, _meet).alias("end"))


def _evened(ups: DataFrame, lacking: DataFrame) -> DataFrame:
    """The settled documents (source, key, up), of which a few small ones change sides to make up for what each source ``lacks``.

    The last document of a source can be large, and rounding it leaves half its size at most.  That much, or too much, is
    taken from documents of fitting sizes and from the smallest, ``POOL`` of each, largest first.
    """
    gap = F.abs("lacks")
    fit = ups.join(lacking.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).where(
        (F.col("up") == F.when(F.col("lacks") > 0, 0).otherwise(1)) & (F.col("key.size") <= gap) & (F.col("key.size") > 0))

    def nearest(*order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("source").orderBy(*order, _uniform(F.col("key"))))
        return fit.withColumn("place", place).where(F.col("place") <= POOL).select("source", "key", "lacks")

    pool = nearest(F.abs(F.col("key.size") - gap / 16)).union(nearest(F.col("key.size"))).distinct()
    listed = pool.groupBy("source").agg(
        F.max(gap).alias("gap"), F.sort_array(F.collect_list(F.struct(F.col("key.size").alias("size"), "key")), asc=False).alias("all"))
    none = F.transform(F.filter("all", lambda x: F.lit(False)), lambda x: x["key"])

    def take(state: Column, x: Column) -> Column:
        fits = x["size"] <= state["left"]
        return F.struct(F.when(fits, state["left"] - x["size"]).otherwise(state["left"]).alias("left"),
                        F.when(fits, F.array_append(state["keys"], x["key"])).otherwise(state["keys"]).alias("keys"))

    chosen = F.aggregate("all", F.struct(F.col("gap").alias("left"), none.alias("keys")), take, lambda state: state["keys"])
    changed = listed.select(F.col("source").alias("of"), F.explode(chosen).alias("whose"))
    met = ups.join(changed, F.col("source").eqNullSafe(F.col("of")) & (F.col("key") == F.col("whose")), "left")
    return met.select("source", "key", F.when(F.col("whose").isNull(), F.col("up")).otherwise(1 - F.col("up")).alias("up"))


def copy_numbers(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(id, source, size, n, source_size, target, copies) from (id, source, size).

    ``n`` numbers the rows that agree in id, source and size.
    """
    same = Window.partitionBy("id", "source", "size").orderBy(F.lit(0))
    rows = materialise(sizes.withColumn("n", F.row_number().over(same)), "mix-sizes")
    aims = materialise(targets(rows, weights, most), "mix-targets")
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    near = F.abs(share - F.round(share)) < _EPS
    per_source = aims.select(
        F.col("source").alias("of"), "source_size", "target",
        F.when(near, F.round(share)).otherwise(F.floor(share)).cast("long").alias("whole"),
        F.when(near, 0.0).otherwise(share - F.floor(share)).alias("p"))
    docs = rows.join(per_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    key = F.struct("id", "size", "n")
    open_rows = docs.where("p > 0 AND size > 0").select("source", key.alias("key"), F.col("size").cast("double").alias("size"), "p")
    counts = open_rows.groupBy("source").agg(F.count("*").alias("docs"))
    most_docs = counts.agg(F.max("docs")).first()[0] or 0  # one number, it tells the tree's height
    width = materialise(counts, "mix-counts").select(F.col("source").alias("of"), F.ceil(F.col("docs") / FAN).alias("groups"))
    items = (open_rows.join(width, F.col("source").eqNullSafe(F.col("of")))
             .withColumn("group", F.pmod(F.xxhash64(F.lit(SEED), "key"), F.col("groups"))).drop("of", "groups"))
    settled = []
    for _ in range(1 + max(0, math.ceil(math.log(max(1, math.ceil(most_docs / FAN)), FAN)))):
        folded = materialise(_fold(items), "mix-level")
        settled.append(folded.select("source", F.explode("end.done").alias("x")).select("source", "x.key", "x.up"))
        items = folded.select("source", F.floor(F.col("group") / FAN).alias("group"), "end.live.key", "end.live.size", "end.live.p")
    last = items.select("source", "key", "size", "p", (F.col("p") >= 0.5).cast("int").alias("up"))
    ups = last.select("source", "key", "up")
    for more in settled:
        ups = ups.unionByName(more)
    ups = _evened(materialise(ups, "mix-ups"), last.select("source", (F.col("size") * (F.col("p") - F.col("up"))).alias("lacks")))
    ups = ups.select(F.col("source").alias("of"), F.col("key").alias("whose"), "up")
    met = docs.withColumn("key", key).join(
        ups, F.col("source").eqNullSafe(F.col("of")) & (F.col("key") == F.col("whose")), "left")
    alone = F.when((F.col("size") == 0) & (F.col("p") > 0), (_uniform(F.col("key")) < F.col("p")).cast("int")).otherwise(0)
    copies = F.col("whole") + F.coalesce(F.col("up"), alone)
    return met.select("id", "source", "size", "n", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of the mix: each input row as often as it is taken."""
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                        size_of(text_col).alias("size"))
    taken = (copy_numbers(named.select("id", "source", "size"), weights, most)
             .groupBy(F.struct("id", "source", "size").alias("whose"))
             .agg(F.array_sort(F.collect_list(F.struct("n", "copies"))).alias("numbers")))
    met = named.withColumn("whose", F.struct("id", "source", "size")).drop("id", "source", "size").join(taken, "whose")
    n = F.row_number().over(Window.partitionBy("whose").orderBy(F.xxhash64("row")))
    copies = F.element_at("numbers", F.col("n"))["copies"].cast("int")
    return (met.withColumn("n", n).withColumn("copies", copies).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select(F.col("doc_id").alias("id"), "source", size_of("text").alias("size"))
    return copy_numbers(sizes).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "source", "copies")
