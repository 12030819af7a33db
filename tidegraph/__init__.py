"""tidegraph: dependence networks, entity histories and series cleaning as Spark DataFrame operators."""

__version__ = "0.1.0"
