"""Binary files in the shared folder, written and read inside tasks through pyarrow.fs."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def publish(*uris: str):
    """Output streams for ``uris``; every file appears under its name only when complete.

    A task attempt writes to names of its own, so a retry or a speculative copy never shows
    half a file; the content depends on the task's rows alone.
    """
    ctx = TaskContext.get()
    tag = f".attempt-{ctx.taskAttemptId() if ctx else 0}"
    places = [open_fs(u) for u in uris]
    streams = []
    for fs, path in places:
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        streams.append(fs.open_output_stream(path + tag))
    try:
        yield streams
    finally:
        for s in streams:
            s.close()
    for fs, path in places:
        fs.move(path + tag, path)


def read_range(uri: str, offset: int, size: int) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(size, offset)
