"""Analytics over machine-assisted code changes, and training-data operators, on Spark."""
