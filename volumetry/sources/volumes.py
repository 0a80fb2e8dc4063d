"""Decoding of volume files into header and brick rows.

A file is decoded where Spark reads it; each volume leaves the task as bounded bricks. Broken files
give a row with an error instead of failing the job.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetry.schema import BRICK_SIDE

# Fixed values of the public NIfTI-1 layout: codes of the sample types.
SAMPLE_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER_BYTES = 348

# A batch handed back to Spark is bounded in samples and in rows.
HELD_SAMPLES = 4_000_000
HELD_ROWS = 4096

DECODED = ("volume_id long, shape array<int>, spacing array<double>, affine array<array<double>>, brick int, "
           "origin array<int>, dims array<int>, value array<float>, error string")


def read_header(data: bytes) -> dict:
    """Grid, spacing, affine and the place of the samples."""
    if len(data) < HEADER_BYTES:
        raise ValueError("file shorter than a header")
    order = "<" if struct.unpack_from("<i", data, 0)[0] == HEADER_BYTES else ">"
    if struct.unpack_from(order + "i", data, 0)[0] != HEADER_BYTES or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", data, 40)
    kind = struct.unpack_from(order + "h", data, 70)[0]
    pixdim = struct.unpack_from(order + "8f", data, 76)
    offset, slope, inter = struct.unpack_from(order + "3f", data, 108)
    if kind not in SAMPLE_TYPES:
        raise ValueError(f"unsupported sample type {kind}")
    shape = [max(int(n), 1) for n in dim[1:dim[0] + 1]]
    shape = (shape + [1, 1, 1])[:max(3, len(shape))]
    return {"order": order, "shape": shape, "spacing": [float(p) for p in pixdim[1:4]], "kind": order + SAMPLE_TYPES[kind],
            "offset": int(offset), "slope": slope, "inter": inter, "affine": _affine(data, order, shape, pixdim)}


def _affine(data: bytes, order: str, shape: list[int], pixdim: tuple) -> list[list[float]]:
    qform, sform = struct.unpack_from(order + "2h", data, 252)
    if sform > 0:
        rows = np.array(struct.unpack_from(order + "12f", data, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *shift = struct.unpack_from(order + "6f", data, 256)
        a = np.sqrt(max(0.0, 1.0 - (b * b + c * c + d * d)))
        turn = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        scale = np.array(pixdim[1:4], dtype=float)
        scale[2] *= -1.0 if pixdim[0] < 0 else 1.0
        rows = np.column_stack([turn * scale, shift])
    else:
        scale = np.array(pixdim[1:4], dtype=float)
        rows = np.column_stack([np.diag(scale), -(np.array(shape[:3]) - 1) / 2.0 * scale])
    return [*rows.astype(float).tolist(), [0.0, 0.0, 0.0, 1.0]]


def decode(content: bytes) -> tuple[dict, np.ndarray]:
    """Header and samples as float32; of a series only the first volume is read."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    head = read_header(data)
    grid = head["shape"][:3]
    cube = np.frombuffer(data, dtype=head["kind"], count=int(np.prod(grid)), offset=head["offset"])
    cube = cube.reshape(grid, order="F").astype("float64")
    if head["slope"] not in (0.0,) and np.isfinite(head["slope"]):
        cube = cube * head["slope"] + head["inter"]
    return head, cube.astype("float32")


_SHAPE, _SPACING = pa.list_(pa.int32()), pa.list_(pa.float64())
BATCH = pa.schema([("volume_id", pa.int64()), ("shape", _SHAPE), ("spacing", _SPACING), ("affine", pa.list_(_SPACING)), ("brick", pa.int32()),
                   ("origin", _SHAPE), ("dims", _SHAPE), ("value", pa.list_(pa.float32())), ("error", pa.string())])


def decode_volumes(files: DataFrame, side: int = BRICK_SIDE) -> DataFrame:
    """``(volume_id, content)`` rows to brick rows; every brick carries its header."""
    def rows(volume_id: int, content: bytes) -> Iterator[tuple]:
        try:
            head, cube = decode(bytes(content))
        except Exception as e:  # noqa: BLE001 - a bad file becomes a row
            yield volume_id, None, None, None, 0, None, None, None, f"{type(e).__name__}: {e}"
            return
        starts = [(x, y, z) for x in range(0, cube.shape[0], side) for y in range(0, cube.shape[1], side)
                  for z in range(0, cube.shape[2], side)]
        for i, (x, y, z) in enumerate(starts):
            part = cube[x:x + side, y:y + side, z:z + side]
            yield (volume_id, list(cube.shape), head["spacing"], head["affine"], i, [x, y, z], list(part.shape),
                   part.reshape(-1), None)

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), BATCH)], schema=BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for volume_id, content in zip(batch.column(0), batch.column(1)):  # one file is Python bytes at a time
                for row in rows(volume_id.as_py(), content.as_py()):
                    held.append(row)
                    size += 0 if row[7] is None else len(row[7])
                    if size >= HELD_SAMPLES or len(held) >= HELD_ROWS:  # keeps the Python worker small
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)

    return files.select(F.col("volume_id").cast("long").alias("volume_id"), "content").mapInArrow(run, DECODED)


def load_volumes(spark: SparkSession, root: str, catalog: DataFrame, pattern: str = "*.nii.gz") -> DataFrame:
    """Decodes the files of a catalog. Files of other volumes are dropped before they are decoded."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(root).select("path", "content")
    )
    return decode_volumes(files.join(catalog.select("path", "volume_id"), "path"))


def headers_of(decoded: DataFrame) -> DataFrame:
    return decoded.where((F.col("brick") == 0) & F.col("error").isNull()).select("volume_id", "shape", "spacing", "affine")


def bricks_of(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNull()).select("volume_id", "origin", "dims", "value")


def failures_of(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNotNull()).select("volume_id", "error")
