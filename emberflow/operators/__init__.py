"""DataFrame operators of the embedding dataflow."""
