"""functions of the content-risk engine."""
