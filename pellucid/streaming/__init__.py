"""streaming of the content-risk engine."""
