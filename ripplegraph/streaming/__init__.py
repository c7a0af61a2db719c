"""Structured Streaming twins of the pulse counters: the same numbers while pulses arrive."""
