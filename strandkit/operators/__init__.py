from .ordered import abortable, batch, batch_timed, buffer, concat, finalize, flat_map, flat_map_table, merge, running_sum, tap

__all__ = ["abortable", "batch", "batch_timed", "buffer", "concat", "finalize", "flat_map", "flat_map_table", "merge", "running_sum", "tap"]
