"""Incremental versions of the transforms, as Structured Streaming jobs."""
