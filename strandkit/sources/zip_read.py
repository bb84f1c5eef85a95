"""Archives as tables: directory, contents, forward scan and lookup over a binary column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CorruptArchive
from ..functions import codec
from . import zip_format as z

DIRECTORY = "archive string, ordinal int, name string, compression_method int, crc32 bigint, compressed_size bigint, uncompressed_size bigint, local_header_offset bigint, last_modified timestamp_ntz, comment string"
ENTRIES = DIRECTORY + ", content binary, status string"
_COLUMNS = [c.split()[0] for c in ENTRIES.split(", ")]


def _row(archive: str, e: z.Entry) -> tuple:
    return (archive, e.ordinal, e.name, e.method, e.crc32, e.compressed_size, e.uncompressed_size, e.offset, e.last_modified, e.comment)


def _read(data: bytes) -> z.Read:
    return lambda at, n: data[at : at + n] if at >= 0 else b""


def _each(archives: DataFrame, schema: str, rows, permissive: bool) -> DataFrame:
    width = len(schema.split(", "))
    own = {m: f for m, f in codec.DECODERS.items() if m not in (codec.STORE, codec.DEFLATE)}  # the caller's decoders go along with the plan

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec.DECODERS.update(own)
        got, held = [], 0
        for frame in frames:
            for name, data in zip(frame["archive"], frame["content"]):
                try:
                    mine = list(rows(name, bytes(data or b"")))
                except CorruptArchive:
                    if not permissive:
                        raise
                    mine = [(name, *[None] * (width - 2), "corrupt")] if schema is ENTRIES else []
                got += mine
                held += 3 * len(data or b"") + 500 * len(mine)
                if held > 32_000_000:  # rows go on before they grow large
                    yield pd.DataFrame(got, columns=_COLUMNS[:width])
                    got, held = [], 0
        yield pd.DataFrame(got, columns=_COLUMNS[:width])

    return archives.select("archive", "content").mapInPandas(run, schema)


def directory(archives: DataFrame, permissive: bool = False) -> DataFrame:
    """Every directory entry, without reading data. A damaged archive fails, or has no rows if permissive."""
    return _each(archives, DIRECTORY, lambda a, d: (_row(a, e) for e in z.directory(len(d), _read(d))), permissive)


def entries(archives: DataFrame, permissive: bool = False) -> DataFrame:
    """Every entry with its content and status. Unless permissive, any status but ok fails; if so, a damaged archive has one row."""

    def rows(a: str, d: bytes):
        read = _read(d)
        for e in z.directory(len(d), read):
            got, status = z.content(e, read)
            if status != "ok" and not permissive:
                raise CorruptArchive(f"{e.name}: {status}")
            yield (*_row(a, e), got, status)

    return _each(archives, ENTRIES, rows, permissive)


def scan(archives: DataFrame, permissive: bool = False) -> DataFrame:
    """Every local entry from the front, orphans included, comments unknown. Junk in front gives no rows, as there is nothing to follow."""

    def rows(a: str, d: bytes):
        for e, got, status in z.scan(d):
            if status != "ok" and not permissive:
                raise CorruptArchive(f"{e.name}: {status}")
            yield (*_row(a, e), got, status)

    return _each(archives, ENTRIES, rows, permissive)


def lookup(rows: DataFrame, name: str) -> DataFrame:
    """The entry of that exact name in every archive; of duplicates the last."""
    return last_of_name(rows.where(F.col("name") == name))


def last_of_name(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("archive", "name").orderBy(F.col("ordinal").desc())
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def from_files(spark, path: str) -> DataFrame:
    """archive (the path), content: archives in a folder or glob of any file system that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
