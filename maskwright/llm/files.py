"""Binary files in the shared folder, written and read by tasks through the folder's own file system."""

from __future__ import annotations

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a URI; a plain path is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def task_file(folder: str, suffix: str) -> str:
    """A name that no other attempt of this task uses; the manifest row that Spark commits says which attempt counts."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.{suffix}"
