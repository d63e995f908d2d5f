"""Binary files that executors write to and read from the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from wirepulse.session import scratch_folder


def output_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one."""
    return f"{scratch_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def attempt_path(folder: str, suffix: str) -> str:
    """A name no other attempt of this or another task uses.

    A task that is run again writes another file; only the paths that successful
    attempts return are ever read, so a half-written file is never taken for a whole one.
    """
    context = TaskContext.get()
    return f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"


def create(path: str):
    """An output stream, its folder made where the file system has folders."""
    system, name = resolve(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def open_file(path: str):
    """A seekable input file."""
    system, name = resolve(path)
    return system.open_input_file(name)
