"""Structured Streaming jobs. Each starts a query that can be stopped and restarted on its checkpoint."""
