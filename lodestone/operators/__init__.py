"""DataFrame -> DataFrame operators, grouped by the part of the pipeline they serve."""
