"""Structured Streaming jobs; each has a batch form in the queries."""
