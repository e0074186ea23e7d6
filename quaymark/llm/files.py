"""Binary files in the shared folder, written and read by tasks.

A file appears under its name only when it is whole: it is written under the task attempt's own name and then moved.
A task that runs again after a lost executor writes the same bytes under the same name.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyarrow import fs
from pyspark import TaskContext


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts: Iterable[bytes]) -> int:
    """Writes the parts one after another; returns the number of bytes."""
    system, path = at(uri)
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 0}.tmp"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    n = 0
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    system.move(own, path)
    return n


def read_range(uri: str, start: int, size: int) -> bytes:
    system, path = at(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, start)


def size_of(uri: str) -> int:
    system, path = at(uri)
    return system.get_file_info(path).size
