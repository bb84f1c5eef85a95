"""Raw deflate as Arrow-batched functions, and a registry of codecs by method number."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STORE, DEFLATE = 0, 8


def deflate_bytes(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def inflate_bytes(data: bytes) -> bytes:
    d = zlib.decompressobj(-15)
    out = d.decompress(data) + d.flush()
    if not d.eof:
        raise ValueError("the deflate stream is cut off")
    return out


#: Method number to decoder, and the name of a compression to its method number and encoder.
DECODERS: dict[int, Callable[[bytes], bytes]] = {STORE: bytes, DEFLATE: inflate_bytes}
ENCODERS: dict[str, tuple[int, Callable[[bytes], bytes]]] = {"store": (STORE, bytes), "deflate": (DEFLATE, deflate_bytes)}


def register(name: str, method: int, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes] | None = None) -> None:
    """Adds a caller's compression: entries that name it are encoded so and carry the method number; plans made later know it.
    A decoder, if given, reads that method; without one its entries read as unsupported."""
    if not name or name in ("store", "deflate") or method in (STORE, DEFLATE) or not 0 <= method <= 0xFFFF:
        raise ValueError("a compression needs a name and method number of its own")
    ENCODERS[name] = (method, encode)
    if decode is not None:
        DECODERS[method] = decode


def _udf(f: Callable[[bytes], bytes]):
    @F.pandas_udf("binary")
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(bytes(v)) for v in values], dtype=object)

    return apply


def encoded(content: Column, compression: Column) -> Column:
    """The content as the named compression stores it; null for an unknown name. Only rows of a compression go through its function."""
    out = F.when(compression == "store", content)
    for name, (_, f) in ENCODERS.items():
        if name != "store":
            out = out.when(compression == name, _udf(f)(F.when(compression == name, content)))
    return out


def method_of(compression: Column) -> Column:
    """The method number of a compression's name; null for an unknown one."""
    out = F.lit(None).cast("int")
    for name, (method, _) in ENCODERS.items():
        out = F.when(compression == name, F.lit(method)).otherwise(out)
    return out


def deflate(column):
    """Null for null; an empty value has a short valid stream."""
    return _udf(deflate_bytes)(column)


def inflate(column):
    """Null for null; a damaged stream fails the query."""
    return _udf(inflate_bytes)(column)
