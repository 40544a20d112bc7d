"""operators of lexiforge."""
