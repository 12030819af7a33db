"""plans of tidegraph."""
