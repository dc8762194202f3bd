"""Graph-intersection analytics and corpus preparation as Spark DataFrame plans."""

__version__ = "0.1.0"
