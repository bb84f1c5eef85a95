"""CRC-32 of values, of ordered chunks, and combined from parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.memory import joined

#: Fixed value: the reflected IEEE 802.3 polynomial.
POLYNOMIAL = 0xEDB88320


def crc(value: Column) -> Column:
    """Of a binary value, or of a text's UTF-8 bytes; 0 for empty, null for null."""
    return F.crc32(value)


def crc_of_chunks(column: str, order_by: list[str]) -> Column:
    """An aggregate: the CRC of a group's chunks joined in order. Use combine for groups beyond 2 GiB."""
    return F.crc32(joined(column, order_by))


def _zero_bit_matrices() -> list[list[int]]:
    """Row k: what each of the 32 bits becomes after 2^k zero bits."""
    one = [POLYNOMIAL] + [1 << i for i in range(31)]
    out = [one]
    for _ in range(66):
        last = out[-1]
        out.append([_times(last, v) for v in last])
    return out


def _times(matrix: list[int], v: int) -> int:
    got, i = 0, 0
    while v:
        if v & 1:
            got ^= matrix[i]
        v >>= 1
        i += 1
    return got


_MATRICES: list[list[int]] = []


def combine(a: int, b: int, len_b: int) -> int:
    """The CRC of A joined with B from their CRCs and B's length in bytes."""
    if not _MATRICES:
        _MATRICES.extend(_zero_bit_matrices())
    bits, k = 8 * len_b, 0
    while bits:
        if bits & 1:
            a = _times(_MATRICES[k], a)
        bits >>= 1
        k += 1
    return a ^ b


def fold_parts(parts: Column) -> Column:
    """The CRC of the whole from an ordered array of structs (c: CRC, n: bytes), with built-in functions only.

    Appending n bytes multiplies by x^(8n) modulo the polynomial; the power is made by repeated squaring over the bits of 8n.
    """
    if not _MATRICES:
        _MATRICES.extend(_zero_bit_matrices())
    table = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in m]) for m in _MATRICES[3:51]])  # lengths up to 2^48 bytes

    def times(matrix: Column, v: Column) -> Column:
        bit = F.sequence(F.lit(0), F.lit(31))
        return F.aggregate(bit, F.lit(0).cast("bigint"), lambda acc, i: F.when(F.call_function("getbit", v, i) == 1, acc.bitwiseXOR(F.get(matrix, i))).otherwise(acc))

    def shift(c: Column, n: Column) -> Column:
        k = F.sequence(F.lit(0), F.lit(47))
        return F.aggregate(k, c, lambda acc, i: F.when(F.call_function("getbit", n, i) == 1, times(F.get(table, i), acc)).otherwise(acc))

    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: shift(acc, p["n"]).bitwiseXOR(p["c"]))
