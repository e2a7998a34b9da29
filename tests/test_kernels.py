import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_plans import noise

from tessera.operators import kernels

INPUT = [[0x000000, 0xFF0000, 0x00FF00], [0x0000FF, 0xFFFFFF, 0x102030], [0x808080, 0x123456, 0xABCDEF]]
GOLDEN = {
    "invert": [[0xFFFFFF, 0x00FFFF, 0xFF00FF], [0xFFFF00, 0x000000, 0xEFDFCF], [0x7F7F7F, 0xEDCBA9, 0x543210]],
    "grayscale": [[0, 0x4C4C4C, 0x959595], [0x1C1C1C, 0xFFFFFF, 0x1D1D1D], [0x808080, 0x2D2D2D, 0xC6C6C6]],
    "blur3": [[0x551C55, 0x56583E, 0x589427], [0x573E7B, 0x5D6770, 0x648F65], [0x5960A1, 0x6475A2, 0x6F8AA4]],
    "sharpen": [[0, 0xFF0000, 0x00FF00], [0x0000FF, 0xFFFFFF, 0], [0xFFFF2B, 0, 0xFFFFFF]],
    "sobel": [[0xFFFFFF, 0xFFFFFF, 0xBCBCBC], [0xFFFFFF, 0xFFFFFF, 0xFFFFFF], [0x707070, 0xFFFFFF, 0xFFFFFF]],
}


def image(df, h, w):
    out = np.full((h, w), -1)
    for r in df.collect():
        assert out[r.y, r.x] == -1
        out[r.y, r.x] = r.p
    return out


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(spark, name):
    rows = [(y, x, p) for y, line in enumerate(INPUT) for x, p in enumerate(line)]
    df = spark.createDataFrame(rows, "y long, x long, p int")
    assert image(kernels.apply(df, name.upper()), 3, 3).tolist() == GOLDEN[name]
    assert kernels.by_name(name).numpy(np.array(INPUT)).tolist() == GOLDEN[name]


@pytest.mark.parametrize("w,h", [(1, 1), (1, 257), (257, 1), (13, 7), (23, 520)])
@pytest.mark.parametrize("name", ["blur3", "sharpen", "sobel"])
def test_forms_agree(spark, name, w, h):
    df = noise(spark, w, h, 7)
    want = kernels.by_name(name).numpy(image(df, h, w))
    assert (image(kernels.apply(df, name), h, w) == want).all()
    assert (image(kernels.apply_tiled(df, name, w, h, 3, 2), h, w) == want).all()


def test_errors_and_own_kernels(spark):
    with pytest.raises(ValueError, match="sobel"):
        kernels.by_name("nothing")
    with pytest.raises(ValueError):
        kernels.apply_tiled(noise(spark, 4, 4), "sobel", 4, 4, 2, 2, halo=0)
    kernels.register(kernels.Kernel("Red", lambda a: a & 0xFF0000, point=lambda p: p.bitwiseAND(0xFF0000)))
    try:
        assert kernels.apply(noise(spark, 3, 3), "red").where(F.col("p").bitwiseAND(0xFFFF) != 0).count() == 0
    finally:
        del kernels.KERNELS["red"]
