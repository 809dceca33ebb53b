"""Nested time series and review data on Spark: one module for each kind of operator."""
