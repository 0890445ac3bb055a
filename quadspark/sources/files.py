"""One file for each row (path, content), written by the tasks that hold the rows, and the way back."""

from __future__ import annotations

import os
import urllib.parse
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def write_files(rows: DataFrame, base: str, skip_existing: bool = False) -> DataFrame:
    """Writes `content` (binary) of each row to base/path and returns path, bytes and whether it was written.

    A file is written under a name of its own and renamed, so a task that runs again leaves no half file.  Nothing happens
    until the result is used."""
    p = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(base)
    base = p.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).makeQualified(p).toString()

    def run(frames):
        f, root = _file_system(base)
        for pdf in frames:
            done = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                target = f"{root}/{path}"
                there = skip_existing and f.get_file_info(target).type.name == "File"
                if not there:
                    f.create_dir(os.path.dirname(target), recursive=True)
                    draft = f"{target}.{uuid.uuid4().hex}"
                    with f.open_output_stream(draft) as out:
                        out.write(bytes(content))
                    f.move(draft, target)
                done.append((path, len(content), not there))
            yield pd.DataFrame(done, columns=["path", "bytes", "written"])

    return rows.select("path", "content").mapInPandas(run, "path string, bytes long, written boolean")


def read_files(spark: SparkSession, base: str, suffix: str) -> DataFrame:
    """path, name (without folders and suffix) and content of all files below a folder with a suffix."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(base)
    return d.select("path", F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\Q" + suffix + r"\E$", "").alias("name"), "content")


def existing_tiles(spark: SparkSession, base: str, suffix: str = "") -> DataFrame:
    """zoom, x and y of files named base/zoom/y/x.suffix, from the listing alone."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(base).select("path")
    part = lambda i: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.[^/]*$", i)
    return d.where(part(1) != "").select(part(1).cast("int").alias("zoom"), part(3).cast("long").alias("x"), part(2).cast("long").alias("y"), "path")
