"""Integer image kernels over pixels (y, x, p), p = 0xRRGGBB: pointwise ones and 3x3 stencils with clamped edges.

A stencil comes in three forms that agree bit for bit: windows over rows and over strips of columns (the main form),
a join with the nine neighbours, and numpy over tiles with a halo. Kernels are looked up by name; more can be added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans import tiles

#: Image rows in a strip: a column of one strip is what a window sorts at once.
STRIP = 256


def channel(p: Column, shift: int) -> Column:
    return F.shiftright(p, shift).bitwiseAND(255)


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int")).cast("int")


def luma(p: Column) -> Column:
    return F.shiftright(channel(p, 16) * 77 + channel(p, 8) * 150 + channel(p, 0) * 29, 8)


def clamp(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(255)), F.lit(0))


def grey(v: Column) -> Column:
    return rgb(v, v, v)


def invert(p: Column) -> Column:
    return F.bitwise_not(p).bitwiseAND(0xFFFFFF).cast("int")


def grayscale(p: Column) -> Column:
    return grey(luma(p))


CHANNELS = (("r", 16), ("g", 8), ("b", 0))


def _vertical(pixels: DataFrame) -> DataFrame:
    """Add up and down: the pixels above and below, the pixel itself at an edge.

    Image rows are dealt to strips with one row of overlap, so that a window sorts one column of one strip.
    """
    strip = F.expr(f"y div {STRIP}")
    low, high = F.expr(f"(y - 1) div {STRIP}"), F.expr(f"(y + 1) div {STRIP}")
    dealt = pixels.select("y", "x", "p", F.explode(F.array_distinct(F.array(strip, F.when(F.col("y") > 0, low).otherwise(strip), high))).alias("strip"))
    w = Window.partitionBy("strip", "x").orderBy("y")
    near = dealt.select("*", F.coalesce(F.lag("p").over(w), "p").alias("up"), F.coalesce(F.lead("p").over(w), "p").alias("down"))
    return near.where(F.col("strip") == strip).drop("strip")


def _beside(name: str, by: int) -> Column:
    w = Window.partitionBy("y").orderBy("x")
    return F.coalesce((F.lag if by < 0 else F.lead)(name).over(w), F.col(name))


def _sums(v: DataFrame) -> DataFrame:
    v = v.select("y", "x", *(sum((channel(F.col(n), s) for n in ("up", "p", "down")), F.lit(0)).alias(c) for c, s in CHANNELS))
    mean = {c: F.expr("0") + _beside(c, -1) + F.col(c) + _beside(c, 1) for c, _ in CHANNELS}
    v = v.select("y", "x", *(mean[c].alias(c) for c, _ in CHANNELS))
    return v.select("y", "x", rgb(*(F.expr(f"{c} div 9") for c, _ in CHANNELS)).alias("p"))


def _sharpen(v: DataFrame) -> DataFrame:
    v = v.select("y", "x", "up", "p", "down", _beside("p", -1).alias("left"), _beside("p", 1).alias("right"))
    sharp = lambda s: clamp(channel(F.col("p"), s) * 5 - sum((channel(F.col(n), s) for n in ("up", "down", "left", "right")), F.lit(0)))
    return v.select("y", "x", rgb(*(sharp(s) for _, s in CHANNELS)).alias("p"))


def _sobel(v: DataFrame) -> DataFrame:
    up, at, down = (luma(F.col(n)) for n in ("up", "p", "down"))
    v = v.select("y", "x", (up + at * 2 + down).alias("s"), (down - up).alias("d"))
    gx = _beside("s", 1) - _beside("s", -1)
    gy = _beside("d", -1) + F.col("d") * 2 + _beside("d", 1)
    v = v.select("y", "x", gx.alias("gx"), gy.alias("gy"))
    return v.select("y", "x", grey(clamp(F.abs("gx") + F.abs("gy"))).alias("p"))


def _np_channels(a: np.ndarray) -> list[np.ndarray]:
    return [a >> 16 & 255, a >> 8 & 255, a & 255]


def _np_join(c: list[np.ndarray]) -> np.ndarray:
    return c[0] << 16 | c[1] << 8 | c[2]


def _np_luma(a: np.ndarray) -> np.ndarray:
    r, g, b = _np_channels(a)
    return (77 * r + 150 * g + 29 * b) >> 8


def _shifts(a: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    e = np.pad(a, 1, mode="edge")
    h, w = a.shape
    return {(dy, dx): e[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def np_blur(a: np.ndarray) -> np.ndarray:
    return _np_join([sum(_shifts(c).values()) // 9 for c in _np_channels(a)])


def np_sharpen(a: np.ndarray) -> np.ndarray:
    out = []
    for c in _np_channels(a):
        s = _shifts(c)
        out.append(np.clip(5 * c - s[-1, 0] - s[1, 0] - s[0, -1] - s[0, 1], 0, 255))
    return _np_join(out)


def np_sobel(a: np.ndarray) -> np.ndarray:
    s = _shifts(_np_luma(a))
    side = lambda k: s[-1, k] + 2 * s[0, k] + s[1, k]
    line = lambda k: s[k, -1] + 2 * s[k, 0] + s[k, 1]
    v = np.minimum(abs(side(1) - side(-1)) + abs(line(1) - line(-1)), 255)
    return _np_join([v, v, v])


@dataclass(frozen=True)
class Kernel:
    name: str
    numpy: Callable[[np.ndarray], np.ndarray]
    point: Callable[[Column], Column] | None = None
    stencil: Callable[[DataFrame], DataFrame] | None = None
    #: An aggregate of a pixel's neighbours, given their value and their offsets.
    joined: Callable[[Column, Column, Column], Column] | None = None


KERNELS: dict[str, Kernel] = {}


def register(kernel: Kernel) -> None:
    KERNELS[kernel.name.lower()] = kernel


for _k in (
    Kernel("invert", lambda a: ~a & 0xFFFFFF, point=invert),
    Kernel("grayscale", lambda a: _np_join([_np_luma(a)] * 3), point=grayscale),
    Kernel("blur3", np_blur, stencil=_sums),
    Kernel("sharpen", np_sharpen, stencil=_sharpen),
    Kernel("sobel", np_sobel, stencil=_sobel),
):
    register(_k)


def find(name: str) -> Kernel | None:
    """The kernel of a name, whatever its case; None if there isn't one."""
    return KERNELS.get(name.lower())


def by_name(name: str) -> Kernel:
    """As find(), but an unknown name is an error."""
    if name.lower() not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; known: {', '.join(sorted(KERNELS))}")
    return KERNELS[name.lower()]


def apply(pixels: DataFrame, name: str) -> DataFrame:
    """y, x, p of a kernel over a whole raster."""
    kernel = by_name(name)
    if kernel.point:
        return pixels.select("y", "x", kernel.point(F.col("p")).alias("p"))
    return kernel.stencil(_vertical(pixels.select("y", "x", "p")))


def apply_joined(pixels: DataFrame, name: str) -> DataFrame:
    """The same as a relational stencil: every pixel names its nine neighbours (at an edge the nearest pixel there is),
    meets them in an equi-join on their place, and is one aggregate of them."""
    kernel = by_name(name)
    if kernel.joined is None:
        raise ValueError(f"{name} has no relational form")
    size = pixels.agg(F.max("y"), F.max("x")).first()
    if size[0] is None:
        return pixels.select("y", "x", "p")
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    place = lambda c, d, most: F.least(F.greatest(F.col(c) + d, F.lit(0).cast("long")), F.lit(most).cast("long"))
    wanted = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), place("y", dy, size[0]).alias("ny"), place("x", dx, size[1]).alias("nx")) for dy, dx in near]
    asked = pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).select("y", "x", F.explode(F.array(*wanted)).alias("w")).select("y", "x", "w.*")
    source = pixels.select(F.col("y").cast("long").alias("ny"), F.col("x").cast("long").alias("nx"), "p")
    return asked.join(source, ["ny", "nx"]).groupBy("y", "x").agg(kernel.joined(F.col("p"), F.col("dy"), F.col("dx")).alias("p"))


def _joined_blur(p: Column, dy: Column, dx: Column) -> Column:
    return rgb(*(F.floor(F.sum(channel(p, s)) / 9) for _, s in CHANNELS))


def _joined_sharpen(p: Column, dy: Column, dx: Column) -> Column:
    weight = F.when((dy == 0) & (dx == 0), 5).when((dy == 0) | (dx == 0), -1).otherwise(0)
    return rgb(*(clamp(F.sum(channel(p, s) * weight)) for _, s in CHANNELS))


def _joined_sobel(p: Column, dy: Column, dx: Column) -> Column:
    gx, gy = F.sum(dx * (2 - F.abs(dy)) * luma(p)), F.sum(dy * (2 - F.abs(dx)) * luma(p))
    return grey(clamp(F.abs(gx) + F.abs(gy)))


for _name, _form in (("blur3", _joined_blur), ("sharpen", _joined_sharpen), ("sobel", _joined_sobel)):
    register(replace(KERNELS[_name], joined=_form))


def apply_tiled(pixels: DataFrame, name: str, width: int, height: int, columns: int, rows: int, halo: int = 1) -> DataFrame:
    """The same by numpy over tiles; stencils need a halo of 1 at least."""
    kernel = by_name(name)
    if kernel.stencil and halo < 1:
        raise ValueError("a 3x3 stencil needs a halo of at least 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        w, h = pdf.x.nunique(), pdf.y.nunique()
        if len(pdf) != w * h:
            raise ValueError(f"tile {pdf.tile.iloc[0]} has {len(pdf)} pixels, not {w} x {h}")
        return pdf.assign(p=kernel.numpy(pdf.p.to_numpy().astype(np.int64).reshape(h, w)).ravel().astype(np.int32))

    cut = tiles.read_pixels(pixels.select("x", "y", "p"), width, height, columns, rows, halo)
    done = cut.groupBy("tile").applyInPandas(run, cut.schema)
    return tiles.write_pixels(done, width, height, columns, rows).select("y", "x", "p")


def compute(pixels: DataFrame, name: str, width: int | None = None, height: int | None = None, path: str = "auto") -> tuple[DataFrame, str]:
    """A kernel's result and the path that it takes: ``windows`` (SQL) or ``tiled`` (numpy).

    The choice never fails: kernels without a SQL form, or a wish for tiles, take the tiled path where the raster's size
    is known, and anything else the windows.
    """
    kernel = by_name(name)
    sql = kernel.point is not None or kernel.stencil is not None
    if width and height and (path == "tiled" or not sql):
        return apply_tiled(pixels, name, width, height, max(1, width // 512), max(1, height // 512)), "tiled"
    if not sql:
        raise ValueError(f"{name} has no SQL form, and tiles need the raster's size")
    return apply(pixels, name), "windows"
