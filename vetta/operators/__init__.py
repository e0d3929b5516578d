"""vetta.operators."""
