"""operators of the content-risk engine."""
