"""Files that tasks write and read themselves, in the shared folder the session names."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from permlens.session import work_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it (file, hdfs, s3 and gs are known to pyarrow)."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def create(folder: str, stem: str, ending: str) -> tuple[str, object]:
    """A new file for this attempt of a task: two attempts never write to one file, and only a successful attempt's name reaches the table
    of files, so retried and lost tasks leave nothing that is read."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}.{ending}"
    system, path = store(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path)


def open_random(uri: str):
    system, path = store(uri)
    return system.open_input_file(path)
