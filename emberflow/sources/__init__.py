"""Batch assembly, files, checkpoints."""
