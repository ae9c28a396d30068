"""tenura — land-registry style analytics expressed as Spark DataFrame operators.

Layout:
  functions/  Column-level helpers (text folding, names, codes, address parsing).
  operators/  Reusable relational building blocks (filters, joins, aggregates,
              windows, ordering, set operations).
  sources/    Readers: fixed-width record files, CSV extracts, landing/provenance,
              and the adapter views that give the driver's tables registry shapes.
  plans/      Composed products: conforming, gold tables, lineage, search,
              data quality, layout/materialisation.
  streaming/  Incremental file manifest (availableNow file stream).
"""

from tenura.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
