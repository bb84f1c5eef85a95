"""The data source `strandzip`: reads archives with seeks, a range of entries a partition, and writes one archive a partition.

Options: path (files or a glob, local or shared), content (true or false: without it only directories are read), name (one entry),
entries_per_partition. For stores that only Spark reads, use zip_read.from_files. Writing streams entries, so an archive may be
larger than memory; a failed task leaves no archive.
"""

from __future__ import annotations

import glob
import os
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import BadEntry, CorruptArchive
from . import zip_format as z
from .zip_read import DIRECTORY, ENTRIES, _row


class _File:
    def __init__(self, path: str):
        self.f = open(path, "rb")  # noqa: SIM115
        self.size = os.fstat(self.f.fileno()).st_size

    def read(self, at: int, n: int) -> bytes:
        if at < 0:
            return b""
        self.f.seek(at)
        return self.f.read(n)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.f.close()


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(p for part in options["path"].split(",") for p in glob.glob(part.removeprefix("file:")))
        self.content = options.get("content", "true").lower() == "true"
        self.name = options.get("name")
        self.step = int(options.get("entries_per_partition", "1000"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            with _File(p) as f:
                n = z.directory_span(f.size, f.read)[0]
            out += [_Range(p, a, min(n, a + self.step)) for a in range(0, n, self.step)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.path:
            return
        with _File(part.path) as f:
            entries = z.directory(f.size, f.read)
            if self.name is not None:
                hit = z.lookup(entries, self.name)
                entries = [hit] if hit and part.first <= hit.ordinal < part.last else []
            else:
                entries = entries[part.first : part.last]
            for e in entries:
                if not self.content:
                    yield _row(part.path, e)
                    continue
                data, status = z.content(e, f.read)
                if status != "ok":
                    raise CorruptArchive(f"{e.name}: {status}")
                yield (*_row(part.path, e), data, status)


class _PushingReader(_Reader):
    """Used where Python filter pushdown is on: an equality on name becomes a lookup."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",) and self.name in (None, f.value):
                self.name = f.value
            else:
                yield f


def _check(i: int, d: dict) -> None:
    """The rules of zip_write.layout for one row; entries of a caller's own compression are written by plans only."""
    name, how = d.get("name"), d.get("compression")
    fault = (
        "a name is required" if not name
        else "the name is over 65535 bytes" if len(name.encode()) > 0xFFFF
        else "content is required" if d.get("content") is None
        else "the comment is over 65535 bytes" if len((d.get("comment") or "").encode()) > 0xFFFF
        else f"no such compression: {how}" if how not in (None, "store", "deflate")
        else None
    )
    if fault:
        raise BadEntry(f"entry {i}: {fault}; name {(name or 'null')[:80]}")


@dataclass
class _Done(WriterCommitMessage):
    part: str
    final: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file:")

    def write(self, rows: Iterator[Row]) -> _Done:
        os.makedirs(self.path, exist_ok=True)
        final = os.path.join(self.path, f"{uuid.uuid4().hex}.zip")
        part = final + ".part"
        try:
            with zipfile.ZipFile(part, "w", allowZip64=True) as out:
                for i, r in enumerate(rows):
                    d = r.asDict()
                    if d.get("aborted"):
                        continue
                    _check(i, d)
                    when = d.get("last_modified")
                    info = zipfile.ZipInfo(d["name"], when.timetuple()[:6] if when else time.gmtime(315532800)[:6])
                    info.compress_type = zipfile.ZIP_STORED if d.get("compression") == "store" else zipfile.ZIP_DEFLATED
                    info.comment = (d.get("comment") or "").encode()
                    out.writestr(info, bytes(d["content"]))
        except BaseException:
            if os.path.exists(part):
                os.remove(part)
            raise
        return _Done(part, final)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m:
                os.rename(m.part, m.final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.part):
                os.remove(m.part)


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandzip"

    def schema(self) -> str:
        return ENTRIES if self.options.get("content", "true").lower() == "true" else DIRECTORY

    def reader(self, schema: StructType) -> DataSourceReader:
        spark = SparkSession.getActiveSession()
        push = self.options.get("pushdown") or (spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") if spark else "false")
        return (_PushingReader if push == "true" else _Reader)(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipSource)
