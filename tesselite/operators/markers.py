"""Latest positions, filtered by a privacy policy before anything else sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselite.functions.grid import floordiv
from tesselite.plans.spec import MarkerPolicy

COLUMNS = ["uuid", "name", "dimension", "x", "z", "updated_at"]


def visible_positions(positions: DataFrame) -> DataFrame:
    """Without spectators and the invisible."""
    return positions.filter(~F.col("spectator") & ~F.col("invisible"))


def latest(positions: DataFrame, online: DataFrame | None = None) -> DataFrame:
    """Last position of each uuid, of those online where a table of them is given."""
    rows = positions if online is None else positions.join(online.select("uuid").distinct(), "uuid", "left_semi")
    rest = [c for c in COLUMNS if c != "uuid"]
    # the whole row breaks ties, so that reruns agree
    return rows.groupBy("uuid").agg(F.max(F.struct("updated_at", *[c for c in rest if c != "updated_at"])).alias("_p")).select("uuid", *[F.col(f"_p.{c}").alias(c) for c in rest])


def blur(v: Column, radius: int) -> Column:
    """Centre of the cell of a position."""
    r = float(max(1, radius))
    return F.floor(v / F.lit(r)) * F.lit(r) + F.lit(r / 2)


def published(current: DataFrame, policy: MarkerPolicy, now_ms: int) -> DataFrame:
    """What may be seen of the latest positions.  Withheld and recent ones are filtered first."""
    if not policy.allowed:
        return current.select(*COLUMNS).filter(F.lit(False))
    late = current.filter(F.lit(now_ms) - F.col("updated_at") >= policy.delay_ms).select(*COLUMNS)
    if policy.blurred:
        late = late.withColumns({"x": blur(F.col("x"), policy.blur_radius), "z": blur(F.col("z"), policy.blur_radius)})
    return late


def published_as_of(positions: DataFrame, policy: MarkerPolicy, now_ms: int) -> DataFrame:
    """An extension: each one's last position that is old enough, where ``published`` hides whoever moved since."""
    old = positions.filter(F.lit(now_ms) - F.col("updated_at") >= policy.delay_ms)
    return published(latest(old), policy, now_ms)


def in_dimension(markers: DataFrame, dimension: str | None, default: str) -> DataFrame:
    return markers.filter(F.col("dimension") == (dimension or default))


def cell_of(v: Column, size: int) -> Column:
    return floordiv(F.floor(v), size)
