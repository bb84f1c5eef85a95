"""Ordered dataflow, checksums and archives as DataFrames."""
