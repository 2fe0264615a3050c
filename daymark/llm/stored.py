"""Files that tasks write into, and read from, the folder all executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from ..session import qualified, scratch_dir


def shared_dir(spark: SparkSession, label: str) -> str:
    return qualified(spark, scratch_dir(spark, label))


def _at(folder: str, name: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:") or ":" not in folder:
        return fs.LocalFileSystem(), os.path.join("/" + folder.removeprefix("file:").lstrip("/"), name)
    store, path = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", folder))
    return store, f"{path}/{name}"


def put(folder: str, name: str, data: bytes) -> None:
    """Write aside and move into place, so a task that runs twice leaves one whole file."""
    store, path = _at(folder, name)
    aside = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        out.write(data)
    store.move(aside, path)


def opened(folder: str, name: str):
    store, path = _at(folder, name)
    return store.open_input_file(path)
