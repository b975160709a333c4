"""Sources of the point-cloud engine."""
