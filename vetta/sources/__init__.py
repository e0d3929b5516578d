"""vetta.sources."""
