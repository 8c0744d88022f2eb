"""Plan-level helpers: lineage cuts, skew-safe joins."""
