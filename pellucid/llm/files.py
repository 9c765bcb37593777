"""Files in the folder that driver and executors share, through pyarrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it (``file:/x`` counts as ``file:///x``)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def create(uri: str, name: str):
    """A stream that writes a new file below a folder, which is made if it is missing."""
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}")


def open_input(uri: str):
    """A file for reads at any offset."""
    system, path = open_fs(uri)
    return system.open_input_file(path)
