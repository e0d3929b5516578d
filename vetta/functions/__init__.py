"""vetta.functions."""
