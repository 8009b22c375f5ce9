"""The change feed, in batches and as a stream, and its sinks."""
