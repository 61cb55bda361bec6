"""Plain files in the shared folder, written and read by tasks through Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path on it."""
    return pafs.FileSystem.from_uri(uri)


def fresh_name(stem: str, suffix: str) -> str:
    """A name no other task attempt writes to; only names that reach the manifest are ever read."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    return f"{stem}-{part:06d}-{uuid.uuid4().hex[:12]}{suffix}"
