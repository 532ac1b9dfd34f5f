"""Binary files in the shared folder, read and written by byte range from any task."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def open_folder(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it."""
    local = re.match(r"(?:file:/*)?(/.*|[^:]*)$", url)
    if local:
        return fs.LocalFileSystem(), ("/" + local[1].lstrip("/") if url.startswith("file:") else local[1])
    return fs.FileSystem.from_uri(url)


class NewFile:
    """A file that appears under its name when it is complete: a task that is run again replaces it by the same bytes."""

    def __init__(self, folder: str, name: str):
        self.fs, root = open_folder(folder)
        self.path, self.part = f"{root}/{name}", f"{root}/_{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


class Pages:
    """Byte ranges of one file."""

    def __init__(self, folder: str, name: str):
        where, root = open_folder(folder)
        self.file = where.open_input_file(f"{root}/{name}")
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(length, start) if length else b""

    def close(self) -> None:
        self.file.close()
