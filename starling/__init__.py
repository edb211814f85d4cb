"""Rating features, leak-free aggregates, ensembles and training-text operators on Spark."""
