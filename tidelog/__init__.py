"""A key-value store's operation log as DataFrames: visible state, lookups, accounting, layout, compaction, recovery."""
