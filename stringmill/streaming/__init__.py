"""The growing-set operators as Structured Streaming jobs."""
