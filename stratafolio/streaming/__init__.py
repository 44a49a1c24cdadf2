"""Structured Streaming: tails of the ledgers, effectively-once sinks, keyed state, event-time windows."""
