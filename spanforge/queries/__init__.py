"""All registered queries of the library; importing a module registers its own."""

from . import graph, history, retrieval, steps, stores, tables  # noqa: F401
