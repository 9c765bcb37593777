"""sources of the content-risk engine."""
