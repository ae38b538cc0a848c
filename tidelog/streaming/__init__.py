"""Delivery: fan-out, retries, circuit breaking, dead letters, sinks."""
