"""Pellucid: content-risk analytics on Spark."""
