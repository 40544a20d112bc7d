"""sources of lexiforge."""
