"""vetta.plans."""
