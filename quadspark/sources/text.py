"""Text formats: ESRI ASCII grids, XYZ points, OBJ, OFF and GeoJSON meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import M, edges
from ..operators.raster import ID

_BLANK = r"[ \t\r]+"


def _words(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), _BLANK), lambda w: w != "")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, numbered by file.  A file is read whole: these formats carry one tile each."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = F.filter(F.transform(F.split("value", "\n"), lambda s: F.trim(s)), lambda s: F.trim(F.replace(s, F.lit("\r"))) != "")
    return whole.select("file", F.posexplode(rows).alias("n", "line"))


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header (raster_id, width, height, x0, y0, cell, no_data) and pixels (raster_id, row, col, z) of grid files.

    The six header lines count by place, not by name; a row of another length than the width is an error."""
    lines = _lines(spark, path).select(F.col("file").alias(ID), "n", _words(F.col("line")).alias("w"))
    value = lambda i, t: F.max(F.when(F.col("n") == i, F.col("w")[1].try_cast("double"))).cast(t)
    head = lines.where("n < 6").groupBy(ID).agg(*[value(i, t).alias(c) for i, (c, t) in enumerate((("width", "int"), ("height", "int"), ("x0", "double"), ("y0", "double"), ("cell", "double"), ("no_data", "double")))])
    rows = lines.where("n >= 6").join(head.select(ID, "width", "no_data"), ID)
    w = F.when(F.size("w") == F.col("width"), F.col("w")).when(F.col("n") >= 6, F.raise_error(F.lit("a row has not as many values as the grid has columns")).cast("array<string>"))
    pix = rows.select(ID, (F.col("n") - 6).alias("row"), "no_data", F.posexplode(w).alias("col", "v"))
    return head, pix.select(ID, "row", "col", F.when(F.col("v").cast("double") != F.col("no_data"), F.col("v").cast("double")).alias("z"))


def ascii_grids(pixels: DataFrame, head: DataFrame) -> DataFrame:
    """path and content of a grid file for each raster; raster and header as `read_ascii_grid` gives them."""
    z = F.coalesce("z", "no_data")
    rows = pixels.join(head, ID).groupBy(ID, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", z.alias("z")))), lambda s: s["z"].cast("string")), " ").alias("line"))
    body = rows.groupBy(ID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n").alias("body"))
    top = F.format_string("ncols %d\nnrows %d\nxllcorner %s\nyllcorner %s\ncellsize %s\nNODATA_value %s\n", "width", "height", F.col("x0").cast("string"), F.col("y0").cast("string"), F.col("cell").cast("string"), F.col("no_data").cast("string"))
    return body.join(head, ID).select(F.concat(F.col(ID).cast("string"), F.lit(".asc")).alias("path"), F.encode(F.concat(top, F.col("body"), F.lit("\n")), "UTF-8").alias("content"))


def read_xyz(spark: SparkSession, path: str, limit: float = 10000.0) -> DataFrame:
    """Points of text files with x, y and z in a line; heights that are no numbers or beyond the limit are left out."""
    w = spark.read.text(path).select(_words(F.col("value")).alias("w")).where(F.size("w") >= 3)
    p = w.select(*[F.col("w")[i].try_cast("double").alias(c) for i, c in enumerate("xyz")])
    return p.where("x is not null and y is not null").where(F.col("z").between(-limit, limit) & ~F.isnan("z"))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of OBJ files (mesh_id is the file); of a corner `i/t/n` the vertex counts, other lines do not."""
    lines = _lines(spark, path).select(F.col("file").alias(M), "n", _words(F.col("line")).alias("w"))
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy(M).orderBy("n")) - 1
    v = lines.where("w[0] = 'v'").select(M, at.cast("long").alias("vid"), *[F.col("w")[i + 1].try_cast("double").alias(c) for i, c in enumerate("xyz")])
    index = lambda i: F.substring_index(F.col("w")[i], "/", 1).try_cast("long") - 1
    f = lines.where("w[0] = 'f'").select(M, at.cast("long").alias("fid"), index(1).alias("a"), index(2).alias("b"), index(3).alias("c"))
    return v, f


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of OFF files; comments from # on are left out; a face that is no triangle is an error."""
    lines = _lines(spark, path).select(F.col("file").alias(M), "n", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where("line <> ''")
    from pyspark.sql.window import Window

    lines = lines.withColumn("k", F.row_number().over(Window.partitionBy(M).orderBy("n")) - 1).withColumn("w", _words(F.col("line")))
    head = lines.where("k = 1").select(M, F.col("w")[0].try_cast("long").alias("nv"), F.col("w")[1].try_cast("long").alias("nf"))
    body = lines.where("k > 1").join(head, M).withColumn("i", F.col("k") - 2)
    v = body.where("i < nv").select(M, F.col("i").cast("long").alias("vid"), *[F.col("w")[j].try_cast("double").alias(c) for j, c in enumerate("xyz")])
    face = (F.col("i") >= F.col("nv")) & (F.col("i") < F.col("nv") + F.col("nf"))  # the optimizer may look at other rows first
    three = F.when(F.col("w")[0].try_cast("int") == 3, F.col("w")).when(face, F.raise_error(F.lit("a face is no triangle")).cast("array<string>"))
    f = body.where(face).select(M, (F.col("i") - F.col("nv")).cast("long").alias("fid"), three.alias("t"))
    return v, f.select(M, "fid", *[F.col("t")[j + 1].try_cast("long").alias(c) for j, c in enumerate("abc")])


def _joined(df: DataFrame, order: str, line: Column) -> DataFrame:
    return df.groupBy(M).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"]), "\n").alias("lines"), F.count(F.lit(1)).alias("n"))


def _files(parts: DataFrame, content: Column, suffix: str) -> DataFrame:
    return parts.select(F.concat(F.col(M).cast("string"), F.lit(suffix)).alias("path"), F.encode(content, "UTF-8").alias("content"))


def _number(c: str) -> Column:
    """18 decimals, or the shortest form with an exponent where those lose digits of a small number."""
    fixed = F.format_string("%.18f", F.col(c))
    return F.when(fixed.try_cast("double") == F.col(c), fixed).otherwise(F.col(c).cast("string"))


def obj_files(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """path and content of an OBJ file for each mesh, indices from 1; vertices must be numbered without gaps."""
    v = _joined(vertices, "vid", F.concat_ws(" ", F.lit("v"), *[_number(c) for c in "xyz"])).select(M, F.col("lines").alias("v"))
    f = _joined(faces, "fid", F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in "abc"])).select(M, F.col("lines").alias("f"))
    return _files(v.join(f, M), F.concat("v", F.lit("\n"), "f", F.lit("\n")), ".obj")


def off_files(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """path and content of an OFF file for each mesh, with the number of distinct edges in its head."""
    v = _joined(vertices, "vid", F.concat_ws(" ", *[_number(c) for c in "xyz"])).select(M, F.col("lines").alias("v"), F.col("n").alias("nv"))
    f = _joined(faces, "fid", F.concat_ws(" ", F.lit("3"), *[F.col(c).cast("string") for c in "abc"])).select(M, F.col("lines").alias("f"), F.col("n").alias("nf"))
    e = edges(faces).select(M, "a", "b").distinct().groupBy(M).agg(F.count(F.lit(1)).alias("ne"))
    return _files(v.join(f, M).join(e, M), F.concat(F.format_string("OFF\n%d %d %d\n", "nv", "nf", "ne"), "v", F.lit("\n"), "f", F.lit("\n")), ".off")


def geojson_files(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """path and content of a GeoJSON file for each mesh: a point for each vertex, then a closed line for each face."""
    geometry = lambda kind, c: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), c.alias("coordinates")).alias("geometry"), F.create_map().cast("map<string,string>").alias("properties")))
    p = _joined(vertices, "vid", geometry("Point", F.array("x", "y", "z"))).select(M, F.col("lines").alias("p"))
    ring = F.array(*[F.array(*[F.col(f"{k}{c}") for c in "xyz"]) for k in "abca"])
    t = _joined(triangles, "fid", geometry("LineString", ring)).select(M, F.col("lines").alias("t"))
    body = F.replace(F.concat("p", F.lit("\n"), "t"), F.lit("\n"), F.lit(",\n"))
    return _files(p.join(t, M), F.concat(F.lit('{"type":"FeatureCollection","features":[\n'), body, F.lit("\n]}\n")), ".geojson")
