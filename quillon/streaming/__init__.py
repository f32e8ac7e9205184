"""Frequencies as streams: counts are sums, so they keep up with new files in Structured Streaming."""
