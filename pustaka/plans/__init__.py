"""Query plans over the project's tables; each module has QUERIES and, where SQL can express them, ORACLE."""

MODULES = ("core_data", "scalars", "joins", "aggregates", "ranking", "dedupe", "search", "classify", "checks", "stateful", "sinks", "library", "keys", "links", "views")
