"""The continuous parts of a harvest as Structured Streaming jobs."""
