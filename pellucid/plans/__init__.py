"""plans of the content-risk engine."""
