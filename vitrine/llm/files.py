"""Files of the library's own formats in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path there."""
    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return system, path.rstrip("/")


class Upload:
    """A file that gets its name only once it is complete, so that a task that is run twice leaves two whole files and the manifest names one."""

    def __init__(self, folder: str, suffix: str):
        self.system, path = opened(folder)
        self.system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.path, self.partial = f"{path}/{self.name}", f"{path}/.{self.name}.partial"
        self.out, self.size = self.system.open_output_stream(self.partial), 0

    def write(self, data: bytes) -> int:
        """Appends data and returns where it starts."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.system.move(self.partial, self.path)
        return self.name


def open_file(folder: str, name: str):
    """A seekable file of the folder."""
    system, path = opened(folder)
    return system.open_input_file(f"{path}/{name}")
