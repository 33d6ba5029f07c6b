"""Structured Streaming: keyed state, micro-batch consolidation, index synchronisation."""
