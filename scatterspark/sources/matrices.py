"""Matrix files: text, binary, sparse text, Matlab and VTK. Writers of one file stream rows through the driver."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scatterspark.session import cut


def read_ascii(spark: SparkSession, path: str) -> DataFrame:
    """``(row, v array<double>)`` of whitespace-separated numbers, rows numbered from 0; all rows must have one length."""
    t = spark.read.text(path).select(F.trim("value").alias("value")).where("value != ''")
    t = cut(t.select(F.monotonically_increasing_id().alias("m"), F.split("value", r"\s+").cast("array<double>").alias("v")))
    counts = t.groupBy(F.shiftright("m", 33).alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("part", before.alias("before")))
    out = t.join(offsets, F.shiftright("m", 33) == F.col("part")).select((F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("row"), "v")
    ends = out.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if ends["a"] != ends["b"]:
        raise ValueError(f"ragged rows: {ends['a']} to {ends['b']} numbers")
    return out


def write_ascii(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows of ``v`` with 10 significant digits."""
    rows.select(F.array_join(F.transform("v", lambda x: F.format_string("%.10g", x)), " ").alias("value")).write.mode(mode).text(path)


def write_sparse_ascii(triplets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``i j v`` with indices from 1; ``mode`` may be append."""
    triplets.select(F.col("i") + 1, F.col("j") + 1, "v").write.mode(mode).csv(path, sep=" ")


def binary_matrix(m: np.ndarray) -> bytes:
    """Header of four 64-bit numbers (element size, row-major flag, rows, columns) and the elements."""
    return struct.pack("<4Q", 8, 1, *m.shape) + np.ascontiguousarray(m, dtype="<f8").tobytes()


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row, v)``; both storage orders are honoured."""

    def parse(frames):
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                size, by_row, r, c = struct.unpack("<4Q", data[:32])
                m = np.frombuffer(data[32:], dtype={8: "<f8", 4: "<f4"}[size]).astype(float)
                m = m.reshape(r, c) if by_row else m.reshape(c, r).T
                yield pd.DataFrame({"path": name, "row": np.arange(r), "v": list(m)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row long, v array<double>")


def matlab_lines(name: str, triplets: Iterable[tuple[int, int, float]]) -> Iterable[str]:
    """A sparse matrix as Matlab text, indices from 1."""
    rows = list(triplets)
    for part, k in (("rows", 0), ("cols", 1)):
        yield f"{part}_{name} = [" + " ".join(str(t[k] + 1) for t in rows) + "];\n"
    yield f"values_{name} = [" + " ".join(f"{t[2]:.10g}" for t in rows) + "];\n"
    yield f"{name} = sparse(rows_{name}, cols_{name}, values_{name});\n"


def vtk_lines(points: list[list[float]], cells: list[tuple[int, ...]] = (), point_data: list[float] | None = None, cell_data: list[float] | None = None) -> Iterable[str]:
    """A legacy VTK unstructured grid: vertices if no cells are given, else lines, triangles or boxes by cell length."""
    kinds = {1: 1, 2: 3, 3: 5, 4: 9, 8: 11}
    cells = cells or [(i,) for i in range(len(points))]
    yield "# vtk DataFile Version 3.0\npoints\nASCII\nDATASET UNSTRUCTURED_GRID\n"
    yield f"POINTS {len(points)} float\n"
    for p in points:
        yield " ".join(f"{x:.10g}" for x in (list(p) + [0.0, 0.0])[:3]) + "\n"
    yield f"CELLS {len(cells)} {sum(len(c) + 1 for c in cells)}\n"
    for c in cells:
        yield " ".join(map(str, (len(c), *c))) + "\n"
    yield f"CELL_TYPES {len(cells)}\n" + "".join(f"{kinds[len(c)]}\n" for c in cells)
    for kind, data in (("POINT", point_data), ("CELL", cell_data)):
        if data is not None:
            yield f"{kind}_DATA {len(data)}\nSCALARS value float 1\nLOOKUP_TABLE default\n" + "".join(f"{x:.10g}\n" for x in data)


def box_cells(boxes: list[tuple[list[float], list[float]]]) -> tuple[list[list[float]], list[tuple[int, ...]]]:
    """Corner points and cells of two- or three-dimensional boxes."""
    points, cells = [], []
    for lo, hi in boxes:
        d = len(lo)
        start = len(points)
        for c in range(1 << d):
            points.append([hi[k] if c >> k & 1 else lo[k] for k in range(d)])
        cells.append(tuple(range(start, start + 8)) if d == 3 else (start, start + 1, start + 3, start + 2))
    return points, cells
