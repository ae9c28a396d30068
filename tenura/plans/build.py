"""Silver -> gold build with fail-fast checks (the nightly build entry point).

Order as in a warehouse build: assert the silver tables are present, build
each gold product and materialise it as a new committed version (K3), then
check the products (unique title key, no empty product, gold rows match the
title table).  Each product is one Spark job; each check is an aggregate that
fails inside its job when it finds something.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenura.plans import gold as G
from tenura.plans import quality as D
from tenura.plans.layout import read_current, refresh

# Silver tables the gold build reads.
BUILD_INPUTS = ("title", "title_estate", "title_instrument", "title_instrument_title", "title_hierarchy",
                "title_encumbrance", "transaction_type", "title_parcel_association", "appellation",
                "address_point", "address_component", "land_district")


def gold_products(t) -> dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]:
    """The gold products in build order, keyed by name; a function makes its product of those built before it."""
    return {
        "dim_title": G.dim_title(t.title, t.land_district),
        "title_search_core": G.title_search_core(t),
        "title_360": G.title_360(t),
        # the search tables are read back from the committed 360 and address tables, not computed again
        "title_search_table": lambda built: G.title_search_table(built["title_360"]),
        "dim_address": G.dim_address(t.address_point, t.address_component, t.title_parcel_association),
        "address_search_table": lambda built: G.address_search_table(built["dim_address"]),
        "fact_title_instrument": G.fact_title_instrument(t.title_instrument_title, t.title_instrument,
                                                         t.transaction_type),       # one row per link
    }


def build(spark: SparkSession, t, root: str, products: dict[str, DataFrame] | None = None,
          per_title: tuple[str, ...] = ("dim_title", "title_search_core", "title_360", "title_search_table")) -> dict[str, str]:
    """Check inputs, materialise every product under ``root``, check outputs.

    Returns product name -> committed version path.  Raises (from inside a
    Spark job) when an input is missing or a check finds rows.
    """
    present = D.present_tables({n: getattr(t, n) for n in BUILD_INPUTS})
    D.assert_empty(D.require_tables(spark, list(BUILD_INPUTS), present), "Missing required tables: ").collect()
    versions, built = {}, {}
    for name, product in (products or gold_products(t)).items():
        versions[name] = refresh(spark, product(built) if callable(product) else product, root, name)
        built[name] = read_current(spark, root, name)
    for n in per_title:
        if n in built:
            D.assert_empty(D.duplicate_keys(built[n], ["title_no"]), f"{n}: duplicate title_no: ").collect()
    D.assert_empty(D.empty_tables(D.table_counts(built)), "Empty products: ").collect()
    if "dim_title" in built:
        parity = D.row_parity(built["dim_title"], t.title)
        D.assert_empty(parity.where("NOT rows_match").select("gold_rows"),
                       "dim_title rows differ from title: ").collect()
    return versions
