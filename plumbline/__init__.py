"""Data governance on Spark: quality rules, profiles, compliance scans, lineage, a catalog and schema evolution."""
