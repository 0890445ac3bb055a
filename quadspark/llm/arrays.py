"""Arrays in the shared folder: written once by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import urllib.parse
import uuid

import numpy as np
from pyspark.sql import SparkSession

_OPEN: dict[str, np.ndarray] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as any worker can resolve it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def store(uri: str, values: np.ndarray) -> None:
    """Writes the array under a name of its own and renames it: a task that runs again writes the same bytes."""
    f, path = _file_system(uri)
    f.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with f.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    f.move(draft, path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The array memory-mapped, kept open by the worker; from a store that cannot be mapped by way of an unlinked local copy."""
    if uri not in _OPEN:
        if len(_OPEN) > 20_000:
            _OPEN.clear()
        f, path = _file_system(uri)
        if f.type_name == "local":
            _OPEN[uri] = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
        else:
            with f.open_input_file(path) as src, tempfile.NamedTemporaryFile() as copy:
                while block := src.read(1 << 24):
                    copy.write(block)
                copy.flush()
                _OPEN[uri] = np.memmap(copy.name, dtype=dtype, mode="r") if os.path.getsize(copy.name) else np.zeros(0, dtype)
    return _OPEN[uri]
