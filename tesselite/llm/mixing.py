"""Mixing sources to target weights.

Sizes are words.  Sources take turns with weights 1, 2, 3 by code point, the null
source last; together they get as much as there is, each at most ``MOST`` times its
own size, and what that leaves over goes to the others by weight.  A source's rate
is its target over its size: each document is taken floor(rate) times, plus one copy
more with probability of the fraction, which a hash of the id, the text and a seed
decides.  Of ``SEEDS`` seeds each source uses the one that comes nearest its target.

That choice serves the targets of small sources and hardly changes a document's chance of the one copy
more: in 2,000 simulated sources of ten documents with lengths of the test tables, documents
shorter than half their source's mean had it 0.999 times as often as the fraction says, those longer than twice the mean
1.027 times and the others 0.991 times; in sources of a hundred documents 1.000, 0.997 and 1.001 times.
A single document that outweighs its source's others is bound to the nearer side.  ``seeds=1`` is the plain draw.

Null and empty texts have size 0.  A source without words has rate 0.  Repeated rows
share their fate.  Extra columns are ignored.  Null ids are hashed as empty text.  An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselite.llm._util import materialise, spread_join, whole_row

MOST = 3
TURNS = 3
SEEDS = 16
#: Sources up to so many are broadcast (a few dozen bytes each) and sorted by one task; beyond, they are joined by salted
#: shuffles and scanned in ranges.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fate(key: Column, text: Column) -> list[Column]:
    """Two numbers below 2**32 that a row's id and text settle."""
    h = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return [F.conv(F.substring(h, a, 8), 16, 10).cast("long").alias(name) for a, name in ((1, "_h"), (9, "_i"))]


def _draw(seed: Column | int) -> Column:
    """A number from 0 below 1 that the row's fate and the seed settle."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    return F.pmod(F.col("_h") + s.cast("long") * F.col("_i"), F.lit(1 << 32)) / F.lit(float(1 << 32))


def _scanned(df: DataFrame, order: list[Column], sums: dict[str, Column], few: bool) -> DataFrame:
    """With the sums over the rows before in an order, and over all.  Few rows go through one window; many are dealt by ranges,
    written, and scanned in two levels."""
    spark = df.sparkSession
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    if few:
        w = before(Window.orderBy(*order))
        return df.withColumns({name: F.coalesce(F.sum(c).over(w), zero) for name, c in sums.items()})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    w = before(Window.orderBy("_p"))
    # a row for each part
    ahead = dealt.groupBy("_p").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    ahead = ahead.select("_p", *[F.coalesce(F.sum(f"_{name}").over(w), zero).alias(f"_{name}") for name in sums])
    inside = before(Window.partitionBy("_p").orderBy(*order))
    out = dealt.withColumns({name: F.coalesce(F.sum(c).over(inside), zero) for name, c in sums.items()}).join(F.broadcast(ahead), "_p")
    return out.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_p", *[f"_{name}" for name in sums])


def targets(sizes: DataFrame, most: int = MOST, turns: int = TURNS, few: bool = True) -> DataFrame:
    """(source, source_size) with target and rate.  Sources are filled up in the order in which they reach their limit; the
    first that the share of what is left doesn't fill sets the level for all, which is what sharing the excess again and again
    ends with.  few: the sources are few enough for one task's window."""
    name = [F.col("source").isNull(), F.col("source")]
    one = F.lit(1).cast("long")
    weighed = _scanned(sizes.select("source", "source_size"), name, {"_rank": one}, few).withColumn("w", F.pmod(F.col("_rank"), F.lit(turns)) + one).withColumn("most", F.col("source_size") * most)
    limit = F.col("most") / F.col("w")
    scanned = _scanned(weighed.drop("_rank"), [limit, *name], {"_most": F.col("most"), "_w": F.col("w")}, few)
    total = weighed.agg(F.sum("source_size").alias("_all"), F.sum("w").alias("_weights"))
    level = (F.col("_all") - F.col("_most")) / (F.col("_weights") - F.col("_w"))
    leveled = scanned.crossJoin(F.broadcast(total)).withColumn("level", level)
    first = leveled.filter(F.col("level") * F.col("w") <= F.col("most")).agg(F.min_by("level", F.struct(limit, *name)).alias("share"))
    # both are single rows
    shared = weighed.crossJoin(F.broadcast(first))
    target = F.least(F.coalesce(F.col("share") * F.col("w"), F.col("most").cast("double")), F.col("most").cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return shared.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def _meet(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Joins per-source columns to rows by source, null to null."""
    right = sources.withColumnRenamed("source", "_s")
    if few:
        return rows.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # a name that is never null
    name = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit(""))
    return spread_join(rows.withColumn("_s", name("source")), right.withColumn("_s", name("_s")), "_s", F.struct("_h", "_i")).drop("_s")


def rates(sized: DataFrame, seeds: int = SEEDS) -> tuple[DataFrame, bool]:
    """Per-source size, target, rate and seed for rows (source, size, _h, _i), and whether they are few."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    known = targets(sizes, few=few)
    met = _meet(sized, known, few).withColumn("_part", F.col("rate") - F.floor("rate"))
    gains = [F.sum(F.when(_draw(k) < F.col("_part"), F.col("size")).otherwise(0)).alias(f"g{k}") for k in range(seeds)]
    gained = met.groupBy("source", "source_size", "target", "rate").agg(F.sum(F.floor("rate") * F.col("size")).alias("_base"), *gains)
    off = F.array_min(F.array(*[F.struct(F.abs(F.col("_base") + F.col(f"g{k}") - F.col("target")).alias("d"), F.lit(k).alias("seed")) for k in range(seeds)]))
    return gained.select("source", "source_size", "target", "rate", off["seed"].alias("seed")), few


def _copies() -> Column:
    return (F.floor("rate") + F.when(_draw(F.col("seed")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def mix(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), seeds: int = SEEDS) -> DataFrame:
    """``keep`` columns, size, source_size, target, copies and taken of every document."""
    own = [F.col(c).alias(f"_k_{c}") for c in keep]
    # two numbers stand for the row, so that equal rows share their fate; the texts are read once
    sized = materialise(documents.select(*own, F.col("source"), words(F.col("text")).alias("size"), *fate(F.col("doc_id"), F.col("text"))), "sizes")
    per, few = rates(sized.select("source", "size", "_h", "_i"), seeds)
    met = _meet(sized, per, few).withColumn("copies", _copies())
    return met.select(*[F.col(f"_k_{c}").alias(c) for c in keep], F.col("size"), F.col("source_size"), F.col("target"), F.col("copies"), (F.col("copies") * F.col("size")).alias("taken"))


def emit(documents: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = documents.select(whole_row(documents).alias("_doc"), F.col("source"), words(F.col("text")).alias("size"), *fate(F.col("doc_id"), F.col("text")))
    per, few = rates(materialise(sized.select("source", "size", "_h", "_i"), "sizes"), seeds)
    met = _meet(sized.drop("size"), per.select("source", "rate", "seed"), few)
    return met.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select("_doc.*")
