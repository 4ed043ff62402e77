"""All plan modules; importing this fills the registry."""

from lectern.plans import checks, documents, incremental, normalise, retrieval, tables  # noqa: F401
from lectern.plans.registry import ORACLE, QUERIES  # noqa: F401
