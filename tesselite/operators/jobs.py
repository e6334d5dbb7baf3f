"""From changes to render jobs: debounce, dedupe, bounded queue, throttle and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselite.functions import grid as g
from tesselite.operators import tiles as t
from tesselite.plans.spec import Profile, Scheduling

CHUNK = ["dimension", "chunk_x", "chunk_z"]


def effective_changes(changes: DataFrame) -> DataFrame:
    """Changes that put another block in place, and new chunks: dimension, chunk_x, chunk_z, ts_ms.  A null previous
    state, an equal state and an equal block type are no change."""
    wrote = F.col("previous_state").isNotNull() & (F.col("previous_state") != F.col("state")) & (F.col("previous_block") != F.col("block"))
    return changes.filter(wrote | F.col("is_new")).select("dimension", g.floordiv(F.col("block_x"), 16).alias("chunk_x"), g.floordiv(F.col("block_z"), 16).alias("chunk_z"), "ts_ms")


def latest_marks(marks: DataFrame) -> DataFrame:
    """Last mark of each chunk; marking anew starts its wait again."""
    return marks.groupBy(*CHUNK).agg(F.max("ts_ms").alias("last_ms"))


def settled(marks: DataFrame, now_ms: int, debounce_ms: int) -> DataFrame:
    """Chunks unmarked for at least the debounce time."""
    return latest_marks(marks).filter(F.lit(now_ms) - F.col("last_ms") >= debounce_ms)


def debounce_islands(marks: DataFrame, debounce_ms: int) -> DataFrame:
    """Runs of marks of a chunk with gaps below the debounce time: island, first_ms, last_ms, marks, ready_ms."""
    order = Window.partitionBy(*CHUNK).orderBy("ts_ms")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(order)
    starts = F.when(gap.isNull() | (gap >= debounce_ms), 1).otherwise(0)
    # equal times have a gap of 0, so the order among them doesn't matter
    island = F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = marks.withColumn("start", starts).withColumn("island", island)
    return runs.groupBy(*CHUNK, "island").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("marks")).withColumn("ready_ms", F.col("last_ms") + debounce_ms)


def metatile_jobs(chunks: DataFrame, profile: Profile) -> DataFrame:
    """Each square of tiles that holds a chunk, once: dimension, zoom, start_x, start_y."""
    tiles = t.with_metatile(t.chunk_tiles(chunks, profile.grid), profile.metatile)
    return tiles.select("dimension", F.lit(profile.grid.max_zoom).alias("zoom"), "start_x", "start_y").distinct()


def bounded_queue(jobs: DataFrame, capacity: int, key: list[str], order: list[str]) -> DataFrame:
    """Jobs in their order with outcome: a repeated key is 'duplicate' and changes nothing; of the others as many as
    the capacity are 'accepted' and the rest 'dropped'.  The queue is one, so its order is total: a window over all
    distinct keys, which the capacity bounds in use (at most 8192 are wanted; ``accepted_jobs`` takes only those)."""
    first = Window.partitionBy(*key).orderBy(*order)
    seen = jobs.withColumn("nth", F.row_number().over(first))
    new = seen.filter("nth = 1").withColumn("place", F.row_number().over(Window.orderBy(*order)))
    met = new.withColumn("outcome", F.when(F.col("place") <= capacity, "accepted").otherwise("dropped")).drop("place")
    return met.unionByName(seen.filter("nth > 1").withColumn("outcome", F.lit("duplicate"))).drop("nth")


def accepted_jobs(jobs: DataFrame, capacity: int, key: list[str], order: list[str]) -> DataFrame:
    """The first ``capacity`` distinct jobs alone, by a distributed top-k."""
    first = jobs.groupBy(*key).agg(F.min(F.struct(*order)).alias("_o"))
    return first.orderBy("_o").limit(capacity).select(*key)


def tps(tick_rate: Column, average_nanos: Column) -> Column:
    return F.least(tick_rate, F.lit(1e9) / (average_nanos + F.lit(1.0)))


def throttle(samples: DataFrame, scheduling: Scheduling, order: list[str], stream: str | None = None) -> DataFrame:
    """Whether rendering is paused after each sample: below one bound it pauses, from the other on it resumes, between
    them it stays.  Each ``stream`` has its own state; a single gauge is one ordered series."""
    flag = F.when(F.col("tps") < F.lit(scheduling.pause_below), True).when(F.col("tps") >= F.lit(scheduling.resume_above), False)
    start = 20.0 < scheduling.pause_below
    w = (Window.partitionBy(stream) if stream else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("paused", F.coalesce(F.last(flag, ignorenulls=True).over(w), F.lit(start)))


def serve(requests: DataFrame, stored: DataFrame, *, version: Column | str, world: Column | str, retry_ms: int) -> DataFrame:
    """Answer to each tile request: status, cache_control, state and retry_after.  Another version or world is not
    found; a stored tile may be kept forever; any other is pending."""
    have = stored.select("dimension", "zoom", "x", "y").distinct().withColumn("_stored", F.lit(True))
    met = requests.join(have, ["dimension", "zoom", "x", "y"], "left")
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    wrong = (F.col("version") != as_col(version)) | (F.col("world") != as_col(world))
    hit = F.coalesce(F.col("_stored"), F.lit(False))
    return met.select(
        *requests.columns, F.when(wrong, 404).otherwise(200).alias("status"), F.when(~wrong & hit, "public, max-age=31536000, immutable").otherwise("no-store").alias("cache_control"),
        F.when(wrong, "gone").when(hit, "ready").otherwise("pending").alias("state"), F.when(~wrong & ~hit, F.lit(max(1, retry_ms // 1000))).alias("retry_after"),
    )


def retry_delay(state: Column, retry_after: Column, retry_ms: int) -> Column:
    """Milliseconds until a client asks again; null if it needn't."""
    return F.when(state == "pending", F.coalesce(retry_after.try_cast("long") * 1000, F.lit(retry_ms).cast("long")))


def poll_interval(mode: Column, poll_ms: Column) -> Column:
    """Milliseconds between a client's looks at positions; null if they are off."""
    return F.when(mode == "off", F.lit(None)).when(poll_ms > 0, poll_ms).otherwise(F.lit(2000)).cast("long")


def not_modified(etag: Column, if_none_match: Column) -> Column:
    return F.when(etag.eqNullSafe(if_none_match), 304).otherwise(200)


def render_order(jobs: DataFrame, dirty: DataFrame, budget: int, paused: bool = False) -> DataFrame:
    """One pass of a worker: nothing while paused; all jobs that wait, and only if none does as many tiles above as the
    budget, deepest first.  Whether a job waits is asked by a join of one row, not by the driver."""
    from tesselite.operators.pyramid import by_priority

    head = jobs.select(F.lit(0).alias("phase"), "dimension", "zoom", F.col("start_x").alias("x"), F.col("start_y").alias("y"))
    waits = jobs.limit(1).select(F.lit(1).alias("_waits"))
    idle = by_priority(dirty, budget).select(F.lit(1).alias("phase"), "dimension", "zoom", "x", "y").withColumn("_one", F.lit(1))
    tail = idle.join(F.broadcast(waits), F.col("_one") == F.col("_waits"), "left_anti").drop("_one")
    out = head.unionByName(tail)
    return out.limit(0) if paused else out


def outcomes(results: DataFrame) -> DataFrame:
    """One row of counters: rendered, failed, dropped, refreshed, hits, misses, hit ratio, and the last failure."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    total = count("hit") + count("miss")
    return results.agg(
        *[count(o).alias(o) for o in ("rendered", "failed", "dropped", "refreshed", "hit", "miss")],
        F.when(total == 0, F.lit(0.0)).otherwise(count("hit").cast("double") / F.greatest(total, F.lit(1))).alias("hit_ratio"),
        F.coalesce(F.max_by(F.when(F.col("outcome") == "failed", F.col("message")), F.when(F.col("outcome") == "failed", F.struct("at", "id"))), F.lit("")).alias("last_failure"),
    )
