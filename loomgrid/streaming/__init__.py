"""Statistics of logs that keep growing, by Structured Streaming."""
