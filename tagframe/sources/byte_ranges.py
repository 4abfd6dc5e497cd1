"""A data source that reads directories by byte ranges, for files too large to hold.

``spark.dataSource.register(DirectorySource)``, then
``spark.read.format("tag_directories").option("path", glob).load()`` gives a row per
directory: file_id, ifd_index, ifd_offset, little_endian, bigtiff, buf, error. Each
read seeks to the header and to every directory of the chain and to nothing else. The
chain ends at offset 0, at an offset met before (CycleInOffsets) or where the file ends
(IoError); errors are a last row without buf.

Paths are those of a file system mounted on all workers, or URIs of any file system
that Arrow opens (``s3://``, ``gs://``, ``hdfs://``, ``file://``). ``*``, ``?`` and
``[..]`` may stand in the last parts of a path. The driver lists names only; a
partition reads ``files_per_partition`` files (16).
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_id string, ifd_index int, ifd_offset decimal(20,0), little_endian boolean, bigtiff boolean, buf binary, error string"


def opened(path: str):
    """(file system, path within it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files that a path with wildcards names; a folder names all files below it."""
    from pyarrow import fs

    scheme, mark, rest = path.rpartition("://")
    parts = rest.split("/")
    plain = next((k for k, p in enumerate(parts) if set(p) & set("*?[")), len(parts))
    where, base = opened(scheme + mark + ("/".join(parts[:plain]) or "/"))
    info = where.get_file_info(base)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        return []
    depth, wild = len(base.rstrip("/").split("/")), parts[plain:]
    found = []
    for f in where.get_file_info(fs.FileSelector(base, recursive=len(wild) != 1)):
        own = f.path.split("/")[depth:]
        if f.type == fs.FileType.File and (not wild or (len(own) == len(wild) and all(map(fnmatchcase, own, wild)))):
            found.append("/".join([scheme + mark + "/".join(parts[:plain]).rstrip("/"), *own]))
    return sorted(found)


class FilePartition(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class DirectoryReader(DataSourceReader):
    def __init__(self, path: str, files_per_partition: int = 16):
        self.path, self.files_per_partition = path, files_per_partition

    def partitions(self) -> list[FilePartition]:
        paths = listed(self.path)
        return [FilePartition(paths[k : k + self.files_per_partition]) for k in range(0, len(paths), self.files_per_partition)]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        for path in partition.paths if partition else []:  # no partitions at all are one without paths
            where, inside = opened(path)
            with where.open_input_file(inside) as f:
                yield from directories(path, f)


def directories(path: str, f) -> Iterator[tuple]:
    """The rows of one file, which has seek(), read() and size()."""
    from decimal import Decimal

    size = f.size()

    def at_most(at: int, n: int) -> bytes:
        if at >= size:
            return b""
        f.seek(at)
        return f.read(min(n, size - at))

    head = at_most(0, 16)
    little = {b"II": True, b"MM": False}.get(head[:2])
    if little is None:
        yield (path, 0, None, None, None, None, "TiffSignatureNotFound")
        return
    order = "little" if little else "big"
    number = lambda b: int.from_bytes(b, order)
    version = number(head[2:4])
    if version not in (42, 43) or (version == 43 and (number(head[4:6]), number(head[6:8])) != (8, 0)):
        yield (path, 0, None, None, None, None, "TiffSignatureInvalid")
        return
    big = version == 43
    count, stride, width = (8, 20, 8) if big else (2, 12, 4)
    first = head[8:16] if big else head[4:8]
    if len(first) < width:
        yield (path, 0, None, None, None, None, "IoError")
        return
    at, met = number(first), set()
    while at:
        k = len(met)
        start = b"" if at in met else at_most(at, count)
        if len(start) < count:
            yield (path, k, Decimal(at), little, big, None, "CycleInOffsets" if at in met else "IoError")
            return
        met.add(at)
        whole = number(start) * stride
        rest = at_most(at + count, whole + width)
        yield (path, k, Decimal(at), little, big, start + rest[:whole], None)
        following = rest[whole : whole + width]
        if len(following) < width:
            yield (path, k + 1, None, little, big, None, "IoError")
            return
        at = number(following)


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tag_directories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options["path"], int(self.options.get("files_per_partition", 16)))
