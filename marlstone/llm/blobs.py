"""Binary files in a store that pyarrow can reach (local and shared folders, object stores, HDFS), by URI.

Writers take a new name for each attempt and return it in their rows; only the rows of the attempt that Spark commits
name a file, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def attempt_name(folder: str, part: int, suffix: str) -> str:
    return f"{folder}/{part:06d}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # else a name in .gz is compressed once more


def read_at(uri: str):
    """A file to seek in."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def remove(uri: str) -> None:
    """A file that no manifest names any more; one that is gone already, as after a repeated attempt, is no error."""
    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        store.delete_file(path)
