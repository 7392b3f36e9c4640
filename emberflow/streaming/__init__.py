"""Structured Streaming: training loop, joins of batch halves, reordering, incremental updates."""
