"""DataFrame and Structured Streaming operators for conversation and document data."""
