"""All registered queries of the library with their SQL."""

from ridgeline.plans import catalog, catalog_frames, catalog_reports, catalog_tables  # noqa: F401 - they register their queries too

queries, oracle_sql = catalog.queries, catalog.oracle_sql
