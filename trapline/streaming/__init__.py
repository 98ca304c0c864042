"""The same work over a growing log, with Structured Streaming."""
