"""Execution helpers: durable intermediates, checked broadcasts, skew-safe top-k and ranks."""
