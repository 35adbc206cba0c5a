"""Registered queries: operators applied to the driver tables, with SQL equivalents."""
