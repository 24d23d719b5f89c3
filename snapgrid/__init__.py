"""snapgrid: Spark jobs over histories of keyed snapshots."""

__version__ = "0.1.0"
