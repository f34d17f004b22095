"""Compare, merge and evolve versions of tables and of schema fleets on Spark."""

__version__ = "0.1.0"
