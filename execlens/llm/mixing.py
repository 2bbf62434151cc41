"""Mixing sources to target weights.

Word totals are summed per source (partial sums before the shuffle, so a hot source costs one row a
task), targets are filled like water up to a cap, and each document is emitted floor(rate) times
plus one hash-seeded copy with the rate's fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_hot, materialize

CAP = 3


def words(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weight_of_rank: Column | None = None, cap: float = CAP) -> DataFrame:
    """One row per source of (source, size): source, source_size, target.

    Sources are ranked by code point, null last; weight_of_rank is a column over `rank` (from 0) and
    defaults to 1, 2, 3, repeating.  Targets share all words by weight and stop at cap times their
    source's size; the excess goes to the others by weight until none is above.  With sources in
    order of cap / weight, the sources that stop are a prefix of that order, which the running sums
    find in one step.  Sources without words get target 0.
    """
    weight = F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), (F.col("rank") % 3 + 1).cast("int")) if weight_of_rank is None else weight_of_rank
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source, not per document, so an order over all of them fits one task
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank"))
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("used", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("used")) / (F.col("weights") - F.col("gone")))
        .withColumn("stops", F.col("source_size") * F.lit(float(cap)) <= F.col("level") * F.col("weight"))
    )
    # the first source that doesn't stop sets the level of all after it
    first_open = F.min(F.when(~F.col("stops"), F.struct((F.col("source_size") / F.col("weight")).alias("k"), F.col("rank"), F.col("level")))).over(whole)
    w = w.withColumn("first_open", first_open)
    target = F.when(F.col("first_open").isNull(), F.col("source_size") * F.lit(float(cap))).otherwise(F.least(F.col("source_size") * F.lit(float(cap)), F.col("first_open.level") * F.col("weight")))
    return w.select("source", "source_size", target.cast("double").alias("target"))


SEEDS = 16
#: Sources up to this number (some 100 bytes each) are broadcast.
BROADCAST_SOURCES = 10_000


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _beside(rows: DataFrame, per: DataFrame, sources: int, total: int) -> DataFrame:
    """rows with the columns of their source, by column key."""
    return rows.join(F.broadcast(per.drop("n")), "key") if sources <= BROADCAST_SOURCES else join_hot(rows, per, ["key"], total).drop("n")


def _copies(id_: Column, seed: int, offset: Column) -> Column:
    """floor(rate) and a draw: a hash of the id, turned by the offset, against the fraction."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_), 11).cast("double") / F.lit(float(1 << 53)) + offset
    return (F.floor(rate) + F.when(h - F.floor(h) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan(sized: DataFrame, seed: int, cap: float) -> tuple[DataFrame, int, int]:
    """Per source: key, source_size, target, offset and n (rows); the number of sources; the number of rows.  sized is (id, source, size), written."""
    keyed = sized.withColumn("key", _key(F.col("source")))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    targets = materialize(source_targets(sized, cap=cap).withColumn("key", _key(F.col("source"))).drop("source").join(counts, "key"))
    sources, total = targets.count(), sized.count()
    rows = _beside(keyed, targets, sources, total)
    sums = rows.groupBy("key").agg(*[F.sum(F.col("size") * _copies(F.col("id"), seed, F.lit(k / SEEDS))).alias(f"t{k}") for k in range(SEEDS)], F.first("target").alias("target"))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k / SEEDS).alias("offset")) for k in range(SEEDS)]))
    return materialize(targets.join(sums.select("key", best["offset"].alias("offset")), "key")), sources, total


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, cap: float = CAP) -> DataFrame:
    """Per row: id, source, size, source_size, target, copies, taken.

    copies = floor(rate) + a Bernoulli draw with chance fraction(rate), rate = target / source_size.
    The draw compares a hash of the id, turned by the source's offset, with the fraction.  Where few
    rows hold most words one draw can miss the target by far, so each source takes, of SEEDS
    offsets, that whose total comes nearest; their totals are sums per source, partial first.

    A null source is a source of its own, a null or empty text has size 0, rows of equal id share
    their draw and are counted as often as they occur, an empty table gives an empty result.
    Reruns agree.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    out = _beside(sized.withColumn("key", _key(F.col("source"))), *plan(sized, seed, cap)).withColumn("copies", _copies(F.col("id"), seed, F.col("offset")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, cap: float = CAP) -> DataFrame:
    """The rows of docs, each as often as mix takes it; columns as in docs.

    Copies follow from a row's id and its source's plan, so that texts aren't shuffled.  Nulls, empty texts
    and repeated rows count as in mix: texts without words are in no one's way and come as often as the
    rate of their source says; rows of a source without words go; an empty table gives no rows.
    """
    at = {c: F.col(f"_c{i}") for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]).withColumn("key", _key(at[source_col]))
    made = _beside(own, *plan(_sized(docs, id_col, text_col, source_col), seed, cap)).withColumn("copies", _copies(at[id_col], seed, F.col("offset")))
    out = made.where("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return out.select(*[x.alias(c) for c, x in at.items()])
