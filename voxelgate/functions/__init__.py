"""Functions of the point-cloud engine."""
