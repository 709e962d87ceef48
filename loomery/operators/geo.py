"""Grid cells on coordinates, and market figures by cell and by the rings around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_step(resolution: int) -> float:
    """A cell's edge in degrees: 0.05 at resolution 7, half of it with each step finer."""
    return 0.05 / 2.0 ** (resolution - 7)


def cell_index(degrees: Column, resolution: int) -> Column:
    """The cell's number along one axis. Numbers are cut off toward 0, so the cell 0 reaches one edge to either side."""
    return (degrees / cell_step(resolution)).cast("bigint")


def cell_id(lat: Column, lng: Column, resolution: int) -> Column:
    """``r7:1115:752``; null without coordinates."""
    return F.concat(F.lit(f"r{resolution}:"), cell_index(lat, resolution).cast("string"), F.lit(":"), cell_index(lng, resolution).cast("string"))


def cell_corner(index: Column, resolution: int) -> Column:
    """The coordinate that a cell's number stands for."""
    return F.round(index * cell_step(resolution), 6)


def market_features(df: DataFrame, lat: str, lng: str, price: str, district: int = 7, local: int = 8, rings: int = 1) -> DataFrame:
    """Add ``cell_district`` and ``cell_local``, the district cell's ``median_price`` and ``n_prices``, ``price_vs_district``, and ``ring_mean`` and ``ring_n`` over the local cell and the ``rings`` around it.

    Cells are summed up first, and neighbours are joined as cells, so a crowded cell is one row there. Null prices
    don't count; rows without coordinates keep nulls.
    """
    rows = df.withColumns({"cell_district": cell_id(F.col(lat), F.col(lng), district), "cell_local": cell_id(F.col(lat), F.col(lng), local)})
    by_district = rows.filter("cell_district IS NOT NULL").groupBy("cell_district").agg(F.median(price).alias("median_price"), F.count(price).alias("n_prices"))
    cells = rows.filter("cell_local IS NOT NULL").groupBy(cell_index(F.col(lat), local).alias("i"), cell_index(F.col(lng), local).alias("j")).agg(F.sum(F.col(price).cast("decimal(38,6)")).alias("t"), F.count(price).alias("n"), F.first("cell_local").alias("cell_local"))
    around = [(i, j) for i in range(-rings, rings + 1) for j in range(-rings, rings + 1)]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in around]))
    lent = cells.select("i", "j", "t", "n", steps.alias("s")).select((F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"), "t", "n")
    ring = lent.groupBy("i", "j").agg(F.sum("t").alias("t"), F.sum("n").alias("ring_n")).join(cells.select("i", "j", "cell_local"), ["i", "j"])
    ring = ring.select("cell_local", F.try_divide(F.col("t").cast("double"), F.col("ring_n")).alias("ring_mean"), "ring_n")
    out = rows.join(by_district, "cell_district", "left").join(ring, "cell_local", "left")
    return out.withColumn("price_vs_district", F.round(F.try_divide(F.col(price), F.col("median_price")), 4))
