"""Product run: all enabled sources to one product table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cardloom.operators.products import (
    HONG_KONG_SITES,
    Site,
    api_products,
    catalog_items,
    catalog_pages,
    detail_prices,
    number_sites,
    union_products,
    with_prices,
)


def product_catalog(
    api_pages: DataFrame | None = None,
    site_pages: DataFrame | None = None,
    detail_pages: DataFrame | None = None,
    sites: Sequence[Site] = HONG_KONG_SITES,
) -> DataFrame:
    """Products of the given sources in their fixed order: the API first, then the sites in order.

    A source that is not given, or a site left out of ``sites``, is switched off. The result still has the order
    columns that :func:`cardloom.operators.products.sort_products` and the product file need.
    """
    sources = [] if api_pages is None else [api_products(api_pages)]
    if site_pages is not None and sites:
        items = catalog_items(catalog_pages(site_pages, sites), sites)
        if detail_pages is not None:
            items = with_prices(items, detail_prices(detail_pages))
        sources.append(number_sites(items, sites))
    return union_products(*sources)
