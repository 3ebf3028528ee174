"""Analytics over case documents and agent trajectories, written as Spark DataFrame operators."""

__version__ = "0.1.0"
