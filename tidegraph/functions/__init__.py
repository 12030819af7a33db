"""functions of tidegraph."""
