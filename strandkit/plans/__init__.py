from .seq import Seq, pipe, track

__all__ = ["Seq", "pipe", "track"]
