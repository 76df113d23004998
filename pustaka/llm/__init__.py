"""Operators for language-model training data. Nothing outside this folder imports it."""

QUERY_MODULES = ("near_duplicate_queries", "encoding_repair_queries", "truth_discovery_queries", "names_queries", "packing_queries", "mixing_queries", "scan_noise_queries", "language_id_queries")
