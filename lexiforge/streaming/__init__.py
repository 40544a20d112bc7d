"""streaming of lexiforge."""
