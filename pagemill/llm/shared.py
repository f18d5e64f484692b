"""Files that executors write into and read from the shared scratch folder, on any file system Arrow can open."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from pagemill.session import scratch_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, as a URI."""
    return f"{scratch_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, parts: list[bytes]) -> None:
    """Write a file under a temporary name and rename it, so that a second attempt of a task replaces it whole."""
    system, path = _open(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(aside) as out:
        for part in parts:
            out.write(part)
    system.move(aside, path)


def get(uri: str):  # noqa: ANN201
    """Bytes of a file: mapped where the file system is mounted, else read once."""
    import pyarrow as pa

    system, path = _open(uri)
    if isinstance(system, pafs.LocalFileSystem):
        return pa.memory_map(path, "r").read_buffer()
    with system.open_input_file(path) as f:
        return f.read_buffer()
