"""Change streams and windowed aggregation on Structured Streaming."""
