"""Training-data operators: packing, mixing, scoring, selection, search and deduplication.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
registered queries; each module holds one operator with its own interface.
"""
