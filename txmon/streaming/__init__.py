"""Structured Streaming: classify-and-route, alerts, windowed totals, sessions, dedup, dormancy."""
