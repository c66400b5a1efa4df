"""Importing this module registers every query of the library."""

from corpuslode.plans import catalog_index, catalog_search, catalog_stats, catalog_text  # noqa: F401
