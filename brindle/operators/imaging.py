"""Pixel frames to point clouds and meshes, as column expressions and windows per image.

A pixel frame has ``image, x, y, r, g, b, a``; decoding needs an imaging library, so frames come decoded.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How results are made, by name, and what each needs.
ENGINES = {"local": "depth from luminance", "gpu": "the same, faster elsewhere", "hosted": "a remote service"}
POINT_BYTES = 32


def resolve_engine(name: str | None) -> str:
    """An engine by name without case; anything else is the local one."""
    return next((e for e in ENGINES if e == (name or "").strip().lower()), "local")


def target_size(width: Column, height: Column, points: int, largest: int = 512) -> tuple[Column, Column]:
    """Width and height near a point budget that keep the aspect, between 8 and ``largest``."""
    aspect = width.cast("double") / height
    h = F.floor(F.sqrt(F.lit(float(max(64, points))) / aspect))
    w = F.floor(h * aspect)
    clamp = lambda c: F.least(F.greatest(c, F.lit(8)), F.lit(largest)).cast("int")
    return clamp(w), clamp(h)


def _resized_axis(frame: DataFrame, axis: str, target: str, channels: list[str]) -> DataFrame:
    """One axis of ``resize``: each pixel adds its weighted channels to the places within the kernel's reach."""
    size = frame.groupBy("image").agg((F.max(axis) + 1).alias("_n"))
    wide = frame.join(size, "image").withColumn("_scale", F.col("_n") / F.col(target))
    fold = F.greatest(F.col("_scale"), F.lit(1.0))
    at = lambda shift: (F.col(axis) + 0.5 + shift * 3 * fold) / F.col("_scale") - 0.5
    low, high = F.greatest(F.ceil(at(-1)), F.lit(0)), F.least(F.floor(at(1)), F.col(target) - 1)
    reached = wide.where(low <= high).withColumn("_to", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    t = ((F.col("_to") + 0.5) * F.col("_scale") - 0.5 - F.col(axis)) / fold * math.pi
    weighed = reached.withColumn("_t", t).withColumn("_w", F.when(F.abs("_t") < 1e-9, 1.0).when(F.abs("_t") >= 3 * math.pi, 0.0).otherwise(3 * F.sin("_t") * F.sin(F.col("_t") / 3) / (F.col("_t") * F.col("_t"))))
    keys = ["image", "w", "h", "y" if axis == "x" else "x"]
    summed = weighed.groupBy(*keys, F.col("_to").alias(axis)).agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in channels])
    return summed.select(*frame.columns)


def resize(pixels: DataFrame, points: int, largest: int = 512) -> DataFrame:
    """``pixels`` resampled to ``target_size`` by a Lanczos kernel of three lobes, one axis after the other.

    A smaller picture widens the kernel by the same factor. Weights are normalised at the edges; channels are rounded
    (first to six places, so that halves don't hang on the order of a sum) and kept within 0..255. A picture's rows are grouped by line, then by column, never all together."""
    channels = ["r", "g", "b", "a"]
    sizes = pixels.groupBy("image").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    w, h = target_size(F.col("_w"), F.col("_h"), points, largest)
    frame = pixels.join(sizes.select("image", w.alias("w"), h.alias("h")), "image").select("image", "x", "y", *[F.col(c).cast("double").alias(c) for c in channels], "w", "h")
    out = _resized_axis(_resized_axis(frame, "x", "w", channels), "y", "h", channels)
    return out.select("image", "x", "y", *[F.least(F.greatest(F.round(F.round(c, 6)), F.lit(0.0)), F.lit(255.0)).cast("int").alias(c) for c in channels])


def depth(pixels: DataFrame) -> DataFrame:
    """``pixels`` with ``depth``: brighter and more central is nearer, between 0 and 1."""
    sizes = pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    wide = pixels.join(sizes, "image")
    luminance = (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")) / 255
    at = lambda c, n: F.col(c) / F.greatest(F.lit(1), F.col(n) - 1) * 2 - 1
    radial = F.sqrt(at("x", "w") * at("x", "w") + at("y", "h") * at("y", "h")) / math.sqrt(2)
    return wide.withColumn("depth", F.least(F.greatest(0.55 * luminance + 0.45 * (1 - radial), F.lit(0.0)), F.lit(1.0)))


def box_blur(frame: DataFrame, column: str, radius: int = 1) -> DataFrame:
    """The mean of a column over each pixel's square, smaller at the edges: a window over rows, then one over columns."""
    row = Window.partitionBy("image", "y").orderBy("x").rangeBetween(-radius, radius)
    line = Window.partitionBy("image", "x").orderBy("y").rangeBetween(-radius, radius)
    summed = frame.withColumn("_s", F.sum(column).over(row)).withColumn("_n", F.count(column).over(row))
    return summed.withColumn(column, F.sum("_s").over(line) / F.sum("_n").over(line)).drop("_s", "_n")


def points(pixels: DataFrame, blur: int = 1) -> DataFrame:
    """One point per pixel that is not transparent: position, scale, colour and rotation."""
    frame = box_blur(depth(pixels), "depth", blur) if blur else depth(pixels)
    scale = F.greatest(2 / F.col("w"), 2 / F.col("h")) * 0.65
    return frame.where("a >= 8").select(
        "image", "x", "y",
        (F.col("x") / F.greatest(F.lit(1), F.col("w") - 1) * 2 - 1).alias("px"),
        (1 - F.col("y") / F.greatest(F.lit(1), F.col("h") - 1) * 2).alias("py"),
        ((F.col("depth") - 0.5) * 0.6).alias("pz"),
        scale.alias("sx"), scale.alias("sy"), (scale * 0.55).alias("sz"),
        "r", "g", "b", "a", F.lit(255).alias("qw"), F.lit(128).alias("qx"), F.lit(128).alias("qy"), F.lit(128).alias("qz"),
    )


def splat_rows(cloud: DataFrame) -> DataFrame:
    """Each point's 32 bytes, little-endian: six floats, four colour bytes, four rotation bytes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            records = np.empty(len(p), [("place", "<f4", 6), ("colour", "u1", 8)])
            records["place"] = p[["px", "py", "pz", "sx", "sy", "sz"]].to_numpy()
            records["colour"] = p[["r", "g", "b", "a", "qw", "qx", "qy", "qz"]].to_numpy()
            raw = records.tobytes()
            out = [raw[i : i + 32] for i in range(0, len(raw), 32)]
            yield pd.DataFrame({"image": p.image, "y": p.y, "x": p.x, "bytes": out})

    kind = cloud.schema["image"].dataType.simpleString()
    return cloud.mapInPandas(run, f"image {kind}, y int, x int, bytes binary")


def write_splats(cloud: DataFrame, path: str) -> None:
    """Point clouds as a table of records sorted by image, row and column: files in that order are the images' bytes."""
    splat_rows(cloud).repartitionByRange("image", "y", "x").sortWithinPartitions("image", "y", "x").write.parquet(path)


def valid_splats(files: DataFrame) -> DataFrame:
    """Files (as ``binaryFile`` reads them) whose length is whole points."""
    return files.where((F.col("length") > 0) & (F.col("length") % POINT_BYTES == 0))


def grid_mesh(spark, columns: int, rows: int, height: str = "0.0") -> tuple[DataFrame, DataFrame]:
    """A tessellated surface over -1..1: vertices (id, x, y, z) with ``z`` by a SQL expression of x and y, and triangles (a, b, c)."""
    cell = spark.range(rows * columns).select((F.col("id") % columns).alias("i"), F.floor(F.col("id") / columns).alias("j"), "id")
    at = lambda c, n: F.col(c) / F.lit(float(max(1, n - 1))) * 2 - 1
    vertices = cell.select("id", at("i", columns).alias("x"), at("j", rows).alias("y")).withColumn("z", F.expr(height).cast("double"))
    corner = cell.where((F.col("i") < columns - 1) & (F.col("j") < rows - 1))
    a, b, c, d = F.col("id"), F.col("id") + 1, F.col("id") + columns, F.col("id") + columns + 1
    pair = F.explode(F.array(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), F.struct(b.alias("a"), d.alias("b"), c.alias("c")))).alias("t")
    return vertices, corner.select(pair).select("t.a", "t.b", "t.c")


def height_mesh(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The surfaces of pixel frames with ``depth``: vertices (id, x, y, z), and triangles (a, b, c) of the ids with their ``quad``.

    An id is the picture with the pixel's place; each pixel with neighbours to the right and below begins a quad of two
    triangles. Neighbours follow from the picture's size, so no join finds them; missing pixels leave holes once the
    triangles meet the vertices."""
    place = lambda right, below: F.struct("image", (F.col("x") + right).cast("int").alias("x"), (F.col("y") + below).cast("int").alias("y"))
    at = lambda c, n: F.col(c) / F.greatest(F.lit(1), F.col(n) - 1) * 2
    vertices = frame.select(place(0, 0).alias("id"), (at("x", "w") - 1).alias("x"), (1 - at("y", "h")).alias("y"), ((F.col("depth") - 0.5) * 0.6).alias("z"))
    a, b, c, d = place(0, 0), place(1, 0), place(0, 1), place(1, 1)
    pair = F.explode(F.array(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), F.struct(b.alias("a"), d.alias("b"), c.alias("c")))).alias("t")
    quads = frame.where((F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1)).select(a.alias("quad"), pair)
    return vertices, quads.select("quad", "t.a", "t.b", "t.c")


def tube_mesh(spark, along: int, around: int, radius: float = 0.2, x: str = "cos(t)", y: str = "sin(t)") -> tuple[DataFrame, DataFrame]:
    """A tube swept along a plane curve of ``t`` in 0..2 pi: rings whose frame is the curve's normal and the z axis."""
    step = 2 * math.pi / along
    ring = spark.range(along * around).select("id", (F.floor(F.col("id") / around) * step).alias("t"), (F.col("id") % around * (2 * math.pi / around)).alias("u"))
    near = lambda e: F.expr(e.replace("(t)", "(t + 1e-4)"))
    placed = ring.withColumn("cx", F.expr(x)).withColumn("cy", F.expr(y)).withColumn("tx", near(x) - F.col("cx")).withColumn("ty", near(y) - F.col("cy"))
    length = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    out = radius * F.cos("u")
    vertices = placed.select("id", (F.col("cx") + out * F.try_divide(F.col("ty"), length)).alias("x"), (F.col("cy") - out * F.try_divide(F.col("tx"), length)).alias("y"), (radius * F.sin("u")).alias("z"))
    total = along * around
    i, next_around = F.col("id"), F.floor(F.col("id") / around) * around + (F.col("id") + 1) % around
    quads = F.explode(F.array(F.struct(i.alias("a"), next_around.alias("b"), ((i + around) % total).alias("c")), F.struct(next_around.alias("a"), ((next_around + around) % total).alias("b"), ((i + around) % total).alias("c")))).alias("q")
    return vertices, ring.select(quads).select("q.a", "q.b", "q.c")


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Area-weighted unit normals: the sum of the cross products of a vertex's triangles."""
    corner = lambda n: vertices.select(F.col("id").alias(n), F.struct("x", "y", "z").alias(f"p{n}"))
    wide = triangles.join(corner("a"), "a").join(corner("b"), "b").join(corner("c"), "c")
    u = [F.col(f"pb.{k}") - F.col(f"pa.{k}") for k in "xyz"]
    v = [F.col(f"pc.{k}") - F.col(f"pa.{k}") for k in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    each = wide.select(F.explode(F.array("a", "b", "c")).alias("id"), *[e.alias(f"n{k}") for e, k in zip(n, "xyz")])
    summed = each.groupBy("id").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    size = F.sqrt(sum((F.col(f"n{k}") * F.col(f"n{k}") for k in "xyz"), F.lit(0.0)))
    return summed.select("id", *[F.coalesce(F.try_divide(F.col(f"n{k}"), size), F.lit(0.0)).alias(f"n{k}") for k in "xyz"])


def glb(positions: list[tuple[float, float, float]], triangles: list[tuple[int, int, int]]) -> bytes:
    """A small mesh as a binary glTF container: a header, a JSON chunk and a data chunk, each padded to four bytes."""
    import json

    points_ = b"".join(struct.pack("<3f", *p) for p in positions)
    indices = b"".join(struct.pack("<3I", *t) for t in triangles)
    low = [min((p[k] for p in positions), default=0.0) for k in range(3)]
    high = [max((p[k] for p in positions), default=0.0) for k in range(3)]
    doc = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "buffers": [{"byteLength": len(points_) + len(indices)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": len(points_)}, {"buffer": 0, "byteOffset": len(points_), "byteLength": len(indices)}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(positions), "type": "VEC3", "min": low, "max": high}, {"bufferView": 1, "componentType": 5125, "count": 3 * len(triangles), "type": "SCALAR"}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    data = points_ + indices + b"\0" * (-len(points_ + indices) % 4)
    body = struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(data), b"BIN\0") + data
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def is_glb(data: bytes) -> bool:
    return data[:4] == b"glTF" and len(data) >= 12 and int.from_bytes(data[8:12], "little") == len(data)
