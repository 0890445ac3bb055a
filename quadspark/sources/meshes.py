"""Mesh files by format name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode, local, mesh
from . import binary, files, text


def terrain_files(vertices: DataFrame, faces: DataFrame, packed: bool = False) -> DataFrame:
    """Quantised meshes of vertices in longitude, latitude and height: streams over each mesh's own box."""
    b = mesh.bounding_box(vertices)
    q = vertices.join(b, mesh.M)
    over = lambda c: encode.quantize(F.col(c), F.col(f"{c}min"), F.col(f"{c}max"))
    q = q.select(mesh.M, "vid", over("x").alias("u"), over("y").alias("v"), over("z").alias("h"))
    return binary.quantized_mesh_files(q, faces, encode.header(vertices), packed)


WRITERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "obj": text.obj_files,
    "off": text.off_files,
    "geojson": lambda v, f: text.geojson_files(mesh.triangles(v, f), v),
    "glb": binary.glb_files,
    "terrain": terrain_files,
    "terrain.gz": lambda v, f: terrain_files(v, f, packed=True),
}
READERS = ("glb", "obj", "off", "parquet", "terrain", "terrain.gz")


def kind_of(path: str) -> str:
    """Format of a file by its extension, the longest that is known."""
    name = path.rsplit("/", 1)[-1].lower()
    fit = [k for k in (*WRITERS, "parquet") if name.endswith(f".{k}")]
    if not fit:
        raise ValueError(f"no mesh format has the extension of {path}")
    return max(fit, key=len)


def save_meshes(vertices: DataFrame, faces: DataFrame, base: str, kind: str, skip_existing: bool = False) -> DataFrame:
    """Writes a file for each mesh, or tables of vertices and faces for `parquet`; returns what was written."""
    if kind == "parquet":
        vertices.write.mode("overwrite").parquet(f"{base}/vertices")
        faces.write.mode("overwrite").parquet(f"{base}/faces")
        return vertices.sparkSession.createDataFrame([(f"{base}/vertices",), (f"{base}/faces",)], "path string")
    if kind not in WRITERS:
        raise ValueError(f"unknown mesh format {kind}; there are {sorted([*WRITERS, 'parquet'])}")
    return files.write_files(WRITERS[kind](vertices, faces), base, skip_existing)


def load_meshes(spark: SparkSession, base: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of all files of a format below a folder.  Quantised meshes do not hold their bounds: x and y are then
    the place in the tile, from 0 to 1, and z is the height."""
    if kind == "parquet":
        return spark.read.parquet(f"{base}/vertices"), spark.read.parquet(f"{base}/faces")
    if kind == "glb":
        return local.split(binary.read_glb_files(files.read_files(spark, base, ".glb")))
    if kind in ("obj", "off"):
        return (text.read_obj if kind == "obj" else text.read_off)(spark, base)
    if kind in ("terrain", "terrain.gz"):
        v, f, head = binary.read_quantized_mesh_files(files.read_files(spark, base, f".{kind}"))
        z = encode.dequantize(F.col("h"), F.col("min_h"), F.col("max_h"))
        return v.join(head.select(mesh.M, "min_h", "max_h"), mesh.M).select(mesh.M, "vid", (F.col("u") / encode.TOP).alias("x"), (F.col("v") / encode.TOP).alias("y"), z.alias("z")), f
    raise ValueError(f"meshes cannot be read as {kind}; there are {READERS}")


def convert_meshes(spark: SparkSession, source: str, kind: str, target: str, to: str, skip_existing: bool = True) -> DataFrame:
    """Reads all meshes of a format below a folder and writes each in another one; returns what was written."""
    v, f = load_meshes(spark, source, kind)
    number = F.regexp_replace(F.regexp_replace(F.col(mesh.M).cast("string"), r"^.*/", ""), r"\..*$", "").cast("long")
    v, f = v.withColumn(mesh.M, number), f.withColumn(mesh.M, number)
    if "u" in v.columns and to not in ("glb", "parquet"):
        v = v.drop("u", "v")
    return save_meshes(v, f, target, to, skip_existing)
