"""Seeds, pages and harvest state as DataFrames."""
