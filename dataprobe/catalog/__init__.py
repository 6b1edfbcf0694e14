"""Every operator as a named query on the given tables, with the SQL that must give the same rows."""

from dataprobe.catalog.registry import REGISTRY, oracles, runnable  # noqa: F401
from dataprobe.catalog import analyses, learning, rowsets, texts, vectors  # noqa: F401
