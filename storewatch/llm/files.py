"""Files that tasks write to and read from the shared folder, named by URI (file, hdfs, s3, ...).

A task writes under a name of its own attempt and reports it in its result row; only reported files are
ever read, so a retried or speculative task cannot mix its output with another's."""
from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def open_output(folder: str, suffix: str):
    """New file in ``folder``: (its URI, output stream)."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """Random-access stream of a file."""
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def one_task_each(manifest: DataFrame) -> DataFrame:
    """The files of a manifest dealt to tasks of their own."""
    return manifest.repartition(max(1, manifest.count()), "path")
