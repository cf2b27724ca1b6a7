"""Members of ZIP archives as a Python data source: a partition is one member, read by its byte range. (SRC-07, SRC-22)

    zip_members(spark, "/data/big.kmz").where("name = 'doc.kml'")

The driver reads the central directory only, ZIP64 or not; a task seeks to its member and reads that range, so one member of a large
archive costs its own bytes. Filters on ``name`` choose the partitions; Spark wants ``spark.sql.python.filterPushdown.enabled`` for that. Paths are local, or of a
file system that Arrow can open.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

# Fixed values of the format: the local header's length, where its name and extra field have their lengths, and the methods stored and deflated.
LOCAL_HEADER, LENGTHS_AT, STORED, DEFLATED = 30, 26, 0, 8


class Ranged(io.RawIOBase):
    """A file that is read by ranges and counts the bytes that were read."""

    def __init__(self, path: str) -> None:
        super().__init__()
        if "://" in path and not path.startswith("file:"):
            from pyarrow.fs import FileSystem

            system, inner = FileSystem.from_uri(path)
            self.file = system.open_input_file(inner)
        else:
            self.file = open("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path, "rb", buffering=0)  # noqa: SIM115
        self.count = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer: bytearray) -> int:
        got = self.file.read(len(buffer))
        buffer[: len(got)] = got
        self.count += len(got)
        return len(got)

    def exactly(self, n: int) -> bytes:
        parts = []
        while n and (part := self.read(n)):
            parts.append(part)
            n -= len(part)
        if n:
            raise EOFError("the archive ends inside a member")
        return b"".join(parts)

    def close(self) -> None:
        self.file.close()
        super().close()


@dataclass
class Member(InputPartition):
    archive: str
    name: str
    size: int
    packed: int
    offset: int
    method: int
    crc: int


def members(path: str) -> tuple[list[Member], int]:
    """The members of an archive, without folders, and the bytes that finding them took."""
    with Ranged(path) as file:
        found = [Member(path, i.filename, i.file_size, i.compress_size, i.header_offset, i.compress_type, i.CRC) for i in zipfile.ZipFile(file).infolist() if not i.is_dir()]
        return found, file.count


def content(member: Member) -> tuple[bytes, int]:
    """A member's bytes, and how many were read for them."""
    with Ranged(member.archive) as file:
        file.seek(member.offset)
        name, extra = struct.unpack_from("<HH", file.exactly(LOCAL_HEADER), LENGTHS_AT)
        file.seek(member.offset + LOCAL_HEADER + name + extra)
        packed = file.exactly(member.packed)
        if member.method not in (STORED, DEFLATED):
            raise ValueError(f"{member.name}: method {member.method} is not known")
        out = zlib.decompress(packed, -15) if member.method == DEFLATED else packed
        if zlib.crc32(out) != member.crc:
            raise ValueError(f"{member.name}: the check sum does not fit")
        return out, file.count


def test_of(f: Filter) -> Callable[[str], bool] | None:
    """A filter on ``name`` as a test; None for other filters."""
    if getattr(f, "attribute", None) != ("name",):
        return None
    kinds = {EqualTo: lambda n: n == f.value, In: lambda n: n in f.value, StringStartsWith: lambda n: n.startswith(f.value), StringEndsWith: lambda n: n.endswith(f.value), StringContains: lambda n: f.value in n}
    return kinds.get(type(f))


class ZipReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths, self.wanted = paths, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Spark asks for what is left over: all that is not on the name."""
        for f in filters:
            if test := test_of(f):
                self.wanted.append(test)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        every = [m for p in self.paths for m in members(p)[0]]
        wanted, self.wanted = self.wanted, []  # the tests stay with the driver
        return [m for m in every if all(t(m.name) for t in wanted)]

    def read(self, partition: Member | None) -> Iterator[tuple]:
        if partition is None:  # no member is wanted
            return
        out, count = content(partition)
        yield partition.archive, partition.name, partition.size, partition.packed, out, count


class ZipMembers(DataSource):
    """``(archive, name, size, packed, content, bytes_read)`` of each member of the archives in ``path``, several separated by ``;``."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, size long, packed long, content binary, bytes_read long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader([p for p in self.options["path"].split(";") if p])


def zip_members(spark: SparkSession, *paths: str) -> DataFrame:
    """The members of some archives; registers the source and turns filter pushdown on in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)
    return spark.read.format(ZipMembers.name()).load(";".join(paths))
