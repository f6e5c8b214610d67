"""Views over the base tables, and the registered queries with their SQL."""
