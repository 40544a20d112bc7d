"""plans of lexiforge."""
