"""Text, JSON, CSV and PNG files as tables."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "id int, startTime bigint, length bigint"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files with line ends as line feeds."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json_arrays(rows: DataFrame, file: str, value: str, path: str) -> None:
    """One JSON array in a file of its own for each value of the column ``file``: an array is bounded by its key."""
    arrays = rows.groupBy(file).agg(F.to_json(F.array_sort(F.collect_list(value))).alias("value"))
    arrays.repartition(F.col(file)).write.mode("overwrite").partitionBy(file).text(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def task_trace(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of tasks; missing times are 0."""
    rows = read_json(spark, path, TRACE)
    return rows.select("id", F.coalesce("startTime", F.lit(0).cast("long")).alias("startTime"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def encode_png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB file of an array of 0xRRGGBB (height x width)."""
    h, w = rgb.shape
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    for k, shift in enumerate((16, 8, 0)):
        raw[:, 1 + k :: 3] = rgb >> shift & 255

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """0xRRGGBB of an 8-bit RGB or RGBA file without interlacing; the alpha channel is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise OSError("not a PNG file")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise OSError("only 8-bit RGB files without interlacing are read")
    w, h, step = head[0], head[1], 3 if head[3] == 2 else 4
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + step * w)
    out, above = np.zeros((h, w, step), np.int32), np.zeros((w, step), np.int32)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].reshape(w, step).astype(np.int32)
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = np.cumsum(line, 0) & 255
        elif kind in (3, 4):
            left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
            for x in range(w):
                if kind == 3:
                    guess = (left + above[x]) >> 1
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                line[x] = left = (line[x] + guess) & 255
                corner = above[x]
        elif kind:
            raise OSError(f"unknown filter {kind}")
        out[y] = above = line
    return out[..., 0] << 16 | out[..., 1] << 8 | out[..., 2]


def tiles_to_png(pixels: DataFrame) -> DataFrame:
    """tile, png of pixels (tile, y, x, p), each tile a full rectangle."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        return pd.DataFrame({"tile": [pdf.tile.iloc[0]], "x": [pdf.x.min()], "y": [pdf.y.min()], "png": [encode_png(pdf.p.to_numpy().reshape(pdf.y.nunique(), pdf.x.nunique()))]})

    return pixels.groupBy("tile").applyInPandas(run, "tile long, x long, y long, png binary")


def png_to_pixels(files: DataFrame) -> DataFrame:
    """tile, y, x, p of images with the place of their first pixel."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                a = decode_png(bytes(r.png))
                y, x = np.indices(a.shape)
                yield pd.DataFrame({"tile": r.tile, "y": y.ravel() + r.y, "x": x.ravel() + r.x, "p": a.ravel().astype(np.int32)})

    return files.select("tile", "x", "y", "png").mapInPandas(run, "tile long, y long, x long, p int")
