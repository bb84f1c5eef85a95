"""Little-endian fields and DOS times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest unsigned 64-bit field that is read: below 2^53.
SAFE = 1 << 53


def le_hex(value: Column, size: int) -> Column:
    """An unsigned number as `size` little-endian bytes, in hex."""
    text = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def le(value: Column | int, size: int) -> Column:
    """An unsigned number as `size` little-endian bytes."""
    return F.unhex(le_hex(F.lit(value) if isinstance(value, int) else value, size))


def le_read(data: Column, offset: Column | int, size: int) -> Column:
    """The unsigned little-endian number of `size` bytes at an offset from 0; 64-bit values of 2^53 and more raise an error."""
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    text = F.hex(F.substring(data, at, F.lit(size)))
    flipped = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    got = F.conv(flipped, 16, 10).cast("decimal(20,0)")
    if size < 8:
        return got.cast("bigint")
    return F.when(got >= SAFE, F.raise_error(F.lit("64-bit field of 2^53 or more")).cast("bigint")).otherwise(got.cast("bigint"))


def dos_date(t: Column) -> Column:
    """Days in DOS form. Years before 1980 count as 1980."""
    year = F.greatest(F.year(t) - 1980, F.lit(0))
    return (F.shiftleft(year.cast("bigint"), 9)).bitwiseOR(F.shiftleft(F.month(t).cast("bigint"), 5)).bitwiseOR(F.dayofmonth(t).cast("bigint"))


def dos_time(t: Column) -> Column:
    """The time of day in DOS form, two seconds a step."""
    return F.shiftleft(F.hour(t).cast("bigint"), 11).bitwiseOR(F.shiftleft(F.minute(t).cast("bigint"), 5)).bitwiseOR(F.floor(F.second(t) / 2).cast("bigint"))


def dos_timestamp(date: Column, time: Column) -> Column:
    """Back to a timestamp without zone. Fields out of range roll over: month 0 is December before, day 0 the last of the month before."""
    year = F.shiftright(date, 9).bitwiseAND(F.lit(0x7F)) + 1980
    month, day = F.shiftright(date, 5).bitwiseAND(F.lit(0xF)), date.bitwiseAND(F.lit(0x1F))
    hour, minute = F.shiftright(time, 11).bitwiseAND(F.lit(0x1F)), F.shiftright(time, 5).bitwiseAND(F.lit(0x3F))
    second = time.bitwiseAND(F.lit(0x1F)) * 2
    first = F.make_timestamp_ntz(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    by_month = first + F.make_interval(months=(month - 1).cast("int"))
    return by_month + F.make_interval(days=(day - 1).cast("int"), hours=hour.cast("int"), mins=minute.cast("int"), secs=second.cast("decimal(18,6)"))
