"""Errors that callers can tell apart."""

import contextlib
import re
from collections.abc import Iterator


class ArchiveError(Exception):
    """Base of the archive errors."""


class CorruptArchive(ArchiveError):
    """The bytes are wrong: signature, truncation, size, checksum or 64-bit records."""


class ArchiveAborted(ArchiveError):
    """The write was cancelled before an archive or an entry began."""


class BadEntry(ArchiveError):
    """An entry has no name or no content, or a name or comment that its field cannot hold."""


class BufferOverflow(Exception):
    """More items arrived in one burst than a buffer of strategy `error` holds."""


class ChannelClosed(Exception):
    """A write after close."""


#: How a plan's own failures begin; Spark hands them back inside errors of its own.
_TYPES = {c.__name__: c for c in (CorruptArchive, ArchiveAborted, BadEntry, BufferOverflow)}
_SAID = re.compile(rf"\b({'|'.join(_TYPES)}): ([^\n]*)")


def typed(e: BaseException) -> BaseException:
    """The error that a plan or worker meant where Spark wrapped it; any other error as it is."""
    if isinstance(e, tuple(_TYPES.values())) or not type(e).__module__.startswith(("pyspark", "py4j")):
        return e
    said = _SAID.search(str(e))
    return _TYPES[said[1]](said[2].strip()) if said else e


@contextlib.contextmanager
def typed_errors() -> Iterator[None]:
    """Raises what typed() makes of an error of the block, with Spark's as its cause."""
    try:
        yield
    except Exception as e:
        meant = typed(e)
        if meant is e:
            raise
        raise meant from e
