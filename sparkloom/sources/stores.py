"""Files of any store that Arrow's file systems reach, for readers and writers that run in Spark's Python workers."""

from __future__ import annotations


def uri(path: str) -> str:
    """file:/a as file:///a, which is the form that Arrow takes."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def store(path: str):
    """(file system, path within it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of all files below the folder, by name; those whose names begin with _ or . don't count."""
    from pyarrow import fs

    system, root = store(path)
    there = system.get_file_info(root)
    if there.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [there] if there.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size) for x in found if x.is_file and x.base_name[0] not in "_.")
