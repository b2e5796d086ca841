"""Random access to files by path or URI, on whatever file system pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str):
    """A seekable file."""
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)


def listed(uri: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder with one of the suffixes, in path order."""
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File]
    return sorted((prefix + i.path, i.size) for i in found if info.type == fs.FileType.File or i.path.lower().endswith(suffixes))
