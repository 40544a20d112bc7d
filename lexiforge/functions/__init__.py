"""functions of lexiforge."""
