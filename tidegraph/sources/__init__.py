"""sources of tidegraph."""
