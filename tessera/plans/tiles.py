"""Tile grids of a raster: exact cover by write rectangles, read rectangles with a halo, cutting and reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_grid(width: int, height: int, columns: int, rows: int, halo: int) -> None:
    if min(width, height) < 1:
        raise ValueError("a raster is at least one pixel wide and high")
    if min(columns, rows) < 1:
        raise ValueError("a grid has at least one tile")
    if halo < 0:
        raise ValueError("a halo isn't negative")


def shape(width: int, height: int, n: int) -> tuple[int, int]:
    """Columns and rows of n tiles with the least sum of tile sides; on a tie the fewest columns."""
    check_grid(width, height, 1, 1, 0)
    if n < 1:
        raise ValueError("a grid has at least one tile")
    return min(((c, n // c) for c in range(1, n + 1) if n % c == 0), key=lambda s: (max(1, width // s[0]) + max(1, height // s[1]), s[0]))


def _side(total: int, parts: Column, at: Column) -> tuple[Column, Column]:
    """Where part ``at`` of a side starts, and how long it is: the first total mod parts parts are longer by one."""
    q, r = F.floor(F.lit(total) / parts), F.lit(total) % parts
    return at * q + F.least(at, r), q + F.when(at < r, 1).otherwise(0)


def grid(spark: SparkSession, width: int, height: int, columns: int, rows: int, halo: int = 0) -> DataFrame:
    """One row for each tile, row-major. No tile is empty: there are at most width columns and height rows."""
    check_grid(width, height, columns, rows, halo)
    columns, rows = min(columns, width), min(rows, height)
    at = spark.range(columns * rows).select(F.col("id").alias("tile"), F.expr(f"id div {columns}").alias("tile_row"), (F.col("id") % columns).alias("tile_column"))
    (x, w), (y, h) = _side(width, F.lit(columns), F.col("tile_column")), _side(height, F.lit(rows), F.col("tile_row"))
    out = at.select("*", x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    left, top = F.greatest(F.col("x") - halo, F.lit(0)), F.greatest(F.col("y") - halo, F.lit(0))
    out = out.select("*", left.alias("read_x"), top.alias("read_y"), F.least(F.col("x") + F.col("width") + halo, F.lit(width)).alias("_r"), F.least(F.col("y") + F.col("height") + halo, F.lit(height)).alias("_b"))
    longs = ["tile", "tile_row", "tile_column", "x", "y", "width", "height", "read_x", "read_y"]
    return out.select(*(F.col(c).cast("long").alias(c) for c in longs), (F.col("_r") - F.col("read_x")).cast("long").alias("read_width"), (F.col("_b") - F.col("read_y")).cast("long").alias("read_height"))


def for_chunks(spark: SparkSession, width: int, height: int, n: int, halo: int = 0) -> DataFrame:
    """A grid for n chunks; fewer tiles if the raster has fewer columns or rows than the best shape."""
    return grid(spark, width, height, *shape(width, height, n), halo)


def measures(tiles: DataFrame) -> DataFrame:
    """Area, and the halo left of and above the write rectangle."""
    return tiles.select("tile", (F.col("width") * F.col("height")).alias("area"), (F.col("x") - F.col("read_x")).alias("halo_left"), (F.col("y") - F.col("read_y")).alias("halo_top"))


def tile_for(tiles: DataFrame, chunk_no: int) -> DataFrame:
    """The tile of a chunk number from 0."""
    n = tiles.count()
    if not 0 <= chunk_no < n:
        raise IndexError(f"tile {chunk_no} of {n}")
    return tiles.where(F.col("tile") == chunk_no)


def tiles_for(tiles: DataFrame, chunks: DataFrame) -> DataFrame:
    """The tile of every chunk_no (from 0), so that a job over tiles can be dealt as a loop; numbers without a tile go."""
    return chunks.join(tiles, F.col("chunk_no") == F.col("tile"))


def _position(at: Column, total: int, parts: int) -> Column:
    """The part of a side that a coordinate falls in."""
    q, r = total // parts, total % parts
    return F.when(at < r * (q + 1), F.expr("0") + F.floor(at / (q + 1))).otherwise(r + F.floor((at - r * (q + 1)) / q)).cast("long")


def read_pixels(pixels: DataFrame, width: int, height: int, columns: int, rows: int, halo: int = 0) -> DataFrame:
    """tile, x, y and the other columns of pixels, for each tile whose read rectangle holds the pixel.

    A pixel's tiles come from arithmetic on its coordinates: no join, and no more rows than halos overlap.
    """
    check_grid(width, height, columns, rows, halo)
    columns, rows = min(columns, width), min(rows, height)
    span = lambda c, total, parts: F.sequence(_position(F.greatest(F.col(c) - halo, F.lit(0)), total, parts), _position(F.least(F.col(c) + halo, F.lit(total - 1)), total, parts))
    out = pixels.select("*", F.explode(span("x", width, columns)).alias("_c"))
    out = out.select("*", F.explode(span("y", height, rows)).alias("_r"))
    return out.select((F.col("_r") * columns + F.col("_c")).alias("tile"), *pixels.columns)


def write_pixels(processed: DataFrame, width: int, height: int, columns: int, rows: int) -> DataFrame:
    """The pixels of processed tiles that are in their tile's write rectangle."""
    columns, rows = min(columns, width), min(rows, height)
    own = _position(F.col("y"), height, rows) * columns + _position(F.col("x"), width, columns)
    return processed.where(F.col("tile") == own)


def missing(tiles: DataFrame, processed: DataFrame) -> DataFrame:
    """Tiles without any processed pixel."""
    return tiles.join(processed.select("tile").distinct(), "tile", "left_anti")


def merge(tiles: DataFrame, processed: DataFrame, width: int, height: int, columns: int, rows: int) -> DataFrame:
    """The whole raster from processed tiles; a missing tile raises ValueError that names it."""
    gone = [r.tile for r in missing(tiles, processed).select("tile").orderBy("tile").limit(20).collect()]
    if gone:
        raise ValueError(f"missing tiles: {', '.join(map(str, gone))}")
    return write_pixels(processed, width, height, columns, rows).drop("tile")


def coverage(tiles: DataFrame) -> DataFrame:
    """Sum of the areas, and how many pixels aren't in exactly one write rectangle."""
    x = F.explode(F.sequence(F.col("x"), F.col("x") + F.col("width") - 1)).alias("px")
    y = F.explode(F.sequence(F.col("y"), F.col("y") + F.col("height") - 1)).alias("py")
    cells = tiles.select("y", "height", x).select("px", y).groupBy("px", "py").count()
    return cells.agg(F.sum("count").alias("total_area"), F.sum((F.col("count") != 1).cast("long")).alias("not_once"))
