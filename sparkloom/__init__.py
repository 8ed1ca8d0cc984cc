"""Conversation and research-note analytics as Spark DataFrame transforms."""
