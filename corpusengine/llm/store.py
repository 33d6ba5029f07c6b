"""Files in the folder that driver and executors share, by whatever file system its address names."""

from __future__ import annotations

from pyarrow import fs as arrow_fs


def filesystem(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of an address and the path in it; the folder above the path exists afterwards."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    found, path = arrow_fs.FileSystem.from_uri(uri)
    found.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return found, path
