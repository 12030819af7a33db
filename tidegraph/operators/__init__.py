"""operators of tidegraph."""
