"""Writing ZIP archives as plans: offsets are prefix sums, headers are little-endian columns, an archive is an ordered join of parts.

Input rows: archive, ord, name, content, compression ('deflate', 'store' or one of codec.register; null deflates), last_modified (timestamp
without zone; null is 1980-01-01), comment, and optionally aborted: an entry whose signal fired is left out and the others stand. An
archive is joined as hex, so it must stay within 1 GiB; the data source writer streams larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArchiveAborted, BadEntry
from ..functions.binary import dos_date, dos_time, le_hex
from ..functions.codec import encoded, method_of
from ..operators.ordered import running_sum
from ..plans.seq import Seq

FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def _fault(entries: DataFrame) -> Column:
    """What is wrong with an entry, as a message; null if nothing is."""
    name, comment = F.col("name"), F.coalesce("comment", F.lit(""))
    what = (
        F.when(name.isNull() | (name == ""), "a name is required")
        .when(F.octet_length(name) > FULL16, "the name is over 65535 bytes")
        .when(F.col("content").isNull(), "content is required")
        .when(F.octet_length(comment) > FULL16, "the comment is over 65535 bytes")
        .when(method_of(_compression()).isNull(), F.concat(F.lit("no such compression: "), F.col("compression")))
    )
    return F.concat(F.lit("entry "), F.col("ord").cast("string"), F.lit(" of archive "), F.coalesce(F.col("archive").cast("string"), F.lit("null")), F.lit(": "), what, F.concat(F.lit("; name "), F.coalesce(F.left(name, F.lit(80)), F.lit("null"))))


def _compression() -> Column:
    return F.coalesce("compression", F.lit("deflate"))


def check_entries(entries: DataFrame) -> None:
    """Fails at once, by a job of its own, where writing would fail: an entry without name or content, or one that does not fit."""
    row = entries.select(_fault(entries).alias("fault")).where(F.col("fault").isNotNull()).first()
    if row:
        raise BadEntry(row["fault"])


def layout(entries: DataFrame, aborted: bool = False, descriptors: bool = False) -> DataFrame:
    """One row an entry with method, crc32, sizes and local_header_offset; the data column `cdata` is not read unless selected.

    Entries are checked as they are read: a bad one fails the query, as BadEntry in a pipeline or under errors.typed_errors().
    """
    if aborted:
        raise ArchiveAborted("cancelled before it began")
    if "aborted" in entries.columns:
        entries = entries.where(~F.coalesce("aborted", F.lit(False)))
    fault = _fault(entries)
    e = entries.select(
        "archive",
        "ord",
        "name",
        F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("BadEntry: "), fault)).cast("binary")).otherwise(F.encode("name", "UTF-8")).alias("raw_name"),
        F.encode(F.coalesce("comment", F.lit("")), "UTF-8").alias("raw_comment"),
        method_of(_compression()).alias("method"),
        F.crc32("content").alias("crc32"),
        F.octet_length("content").cast("bigint").alias("usize"),
        encoded(F.col("content"), _compression()).alias("cdata"),
        F.coalesce("last_modified", F.lit("1980-01-01 00:00:00").cast("timestamp_ntz")).alias("last_modified"),
    )
    return placed(e.withColumn("csize", F.octet_length("cdata").cast("bigint")), descriptors=descriptors)


def _wide() -> Column:
    return (F.col("csize") >= FULL32) | (F.col("usize") >= FULL32)


def _local_size() -> Column:
    """Bytes of an entry's header and data."""
    return F.lit(30) + F.octet_length("raw_name") + F.when(_wide(), 20).otherwise(0) + F.col("csize")


def _central_size() -> Column:
    return F.lit(46) + F.octet_length("raw_name") + F.octet_length("raw_comment") + F.when(_wide() | (F.col("local_header_offset") >= FULL32), 28).otherwise(0)


def _descriptor_size(descriptors: bool) -> Column:
    return F.when(_wide(), 24).otherwise(16) if descriptors else F.lit(0)


def placed(e: DataFrame, spread: bool = False, descriptors: bool = False) -> DataFrame:
    """Adds local_header_offset, the bytes of an archive before each entry, from name and data sizes. With `spread`, the entries of a
    very large archive are summed in many tasks, at the price of a small job first; where whole archives are made they meet anyway."""
    size = _local_size() + _descriptor_size(descriptors)
    if spread:
        df = running_sum("__end", size)(Seq(e, ("ord",), ("archive",))).df
        return df.withColumn("local_header_offset", (F.col("__end") - size).cast("bigint")).drop("__end")
    before = Seq(e, ("ord",), ("archive",)).window().rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("local_header_offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))


def _n(v: Column | int, size: int) -> Column:
    return le_hex(F.lit(v) if isinstance(v, int) else v, size)


def descriptor_hex() -> Column:
    """What follows an entry's data where the header did not know the checksum and sizes: these, with 64-bit sizes if one needs them."""
    sizes = F.when(_wide(), F.concat(_n(F.col("csize"), 8), _n(F.col("usize"), 8))).otherwise(F.concat(_n(F.col("csize"), 4), _n(F.col("usize"), 4)))
    return F.concat(F.lit("504B0708"), _n(F.col("crc32"), 4), sizes)


def local_header_hex(descriptors: bool = False) -> Column:
    """Header, name and, only if a size needs it, the 64-bit field. With `descriptors` checksum and sizes are left to a descriptor."""
    csize, usize = F.col("csize"), F.col("usize")
    wide = _wide()
    cs, us = F.when(wide, FULL32).otherwise(csize), F.when(wide, FULL32).otherwise(usize)
    if descriptors:
        return F.concat(
            F.lit("504B0304"), _n(F.when(wide, 45).otherwise(20), 2), _n(1 << 11 | 1 << 3, 2), _n(F.col("method"), 2), _n(dos_time(F.col("last_modified")), 2), _n(dos_date(F.col("last_modified")), 2), _n(0, 4),
            _n(F.when(wide, FULL32).otherwise(0), 4), _n(F.when(wide, FULL32).otherwise(0), 4), _n(F.octet_length("raw_name"), 2), _n(F.when(wide, 20).otherwise(0), 2), F.hex("raw_name"),
            F.when(wide, F.concat(_n(1, 2), _n(16, 2), _n(0, 8), _n(0, 8))).otherwise(""),
        )
    return F.concat(
        F.lit("504B0304"), _n(F.when(wide, 45).otherwise(20), 2), _n(1 << 11, 2), _n(F.col("method"), 2), _n(dos_time(F.col("last_modified")), 2),
        _n(dos_date(F.col("last_modified")), 2), _n(F.col("crc32"), 4), _n(cs, 4), _n(us, 4), _n(F.octet_length("raw_name"), 2), _n(F.when(wide, 20).otherwise(0), 2),
        F.hex("raw_name"), F.when(wide, F.concat(_n(1, 2), _n(16, 2), _n(usize, 8), _n(csize, 8))).otherwise(""),
    )


def central_hex(descriptors: bool = False) -> Column:
    """If any of the three numbers needs 64 bits, all three go to the extra field."""
    csize, usize, off = F.col("csize"), F.col("usize"), F.col("local_header_offset")
    wide = (csize >= FULL32) | (usize >= FULL32) | (off >= FULL32)
    pick = lambda c: F.when(wide, FULL32).otherwise(c)
    return F.concat(
        F.lit("504B0102"), _n(30, 2), _n(F.when(wide, 45).otherwise(20), 2), _n(1 << 11 | (1 << 3 if descriptors else 0), 2), _n(F.col("method"), 2), _n(dos_time(F.col("last_modified")), 2),
        _n(dos_date(F.col("last_modified")), 2), _n(F.col("crc32"), 4), _n(pick(csize), 4), _n(pick(usize), 4), _n(F.octet_length("raw_name"), 2),
        _n(F.when(wide, 28).otherwise(0), 2), _n(F.octet_length("raw_comment"), 2), _n(0, 2), _n(0, 2), _n(0, 4), _n(pick(off), 4), F.hex("raw_name"),
        F.when(wide, F.concat(_n(1, 2), _n(24, 2), _n(usize, 8), _n(csize, 8), _n(off, 8))).otherwise(""), F.hex("raw_comment"),
    )


def end_hex(n: Column, size: Column, offset: Column) -> Column:
    wide = (n >= FULL16) | (size >= FULL32) | (offset >= FULL32)
    end64 = F.concat(F.lit("504B0606"), _n(44, 8), _n(30, 2), _n(45, 2), _n(0, 4), _n(0, 4), _n(n, 8), _n(n, 8), _n(size, 8), _n(offset, 8), F.lit("504B0607"), _n(0, 4), _n(offset + size, 8), _n(1, 4))
    k = F.when(wide, FULL16).otherwise(n)
    return F.concat(F.when(wide, end64).otherwise(""), F.lit("504B0506"), _n(0, 2), _n(0, 2), _n(k, 2), _n(k, 2), _n(F.when(wide, FULL32).otherwise(size), 4), _n(F.when(wide, FULL32).otherwise(offset), 4), _n(0, 2))


def ends(laid: DataFrame) -> DataFrame:
    """archive, n_entries, cd_size, cd_offset."""
    return laid.groupBy("archive").agg(F.count("*").alias("n_entries"), F.sum(_central_size()).cast("bigint").alias("cd_size"), F.sum(_local_size()).cast("bigint").alias("cd_offset"))


def archives(entries: DataFrame, aborted: bool = False, descriptors: bool = False) -> DataFrame:
    """archive, content: one row an archive. A failing entry fails the query; no archive is half written.

    Each entry is read and compressed once: its row gives its local part and its directory part, and the sizes for the end record. With
    `descriptors`, archives look as a writer without seeks leaves them; such entries are read from the front only if they are deflated.
    """
    laid = layout(entries, aborted, descriptors)
    tail = descriptor_hex() if descriptors else F.lit("")
    item = F.struct("ord", F.concat(local_header_hex(descriptors), F.hex("cdata"), tail).alias("local"), central_hex(descriptors).alias("central"))
    whole = laid.groupBy("archive").agg(
        F.array_sort(F.collect_list(item)).alias("p"),
        F.count("*").alias("n"),
        F.sum(_central_size()).cast("bigint").alias("size"),
        F.sum(_local_size() + _descriptor_size(descriptors)).cast("bigint").alias("offset"),
    )
    parts = [F.array_join(F.col(f"p.{name}"), "") for name in ("local", "central")]
    return whole.select("archive", F.unhex(F.concat(*parts, end_hex(F.col("n"), F.col("size"), F.col("offset")))).alias("content"))


#: An archive without entries.
EMPTY_ARCHIVE = b"PK\x05\x06" + bytes(18)
