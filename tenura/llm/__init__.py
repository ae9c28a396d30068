"""Training-data operators: deduplication, decontamination, quality, language, mixing.

Each module is one operator with its own general interface; ``queries`` holds the
thin ``opN_`` queries of the driver contract.  Nothing else in the library imports
this package, but for ``components`` (the lineage cycles).
"""
