"""streaming of tidegraph."""
