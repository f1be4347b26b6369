"""Record linkage of noisy machine-read records against a catalog, on Spark."""
