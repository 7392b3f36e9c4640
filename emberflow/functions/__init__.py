"""Column functions: unsigned keys, vectors, optimizer steps."""
