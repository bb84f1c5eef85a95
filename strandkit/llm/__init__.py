"""Training-data operators: mixing, similarity joins, classifiers, filters, extraction and scans.

Each module holds one operator with its own interface; ``queries`` holds the thin queries over the standard tables.
Nothing outside this subpackage imports it.
"""
