"""Whole flows: the engine session, forward, backward, inference."""
