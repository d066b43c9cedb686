"""Daily panel time series on Spark: quality checks, climatologies, runs, features,
splits, models, metrics, drift, rules and streaming, all as DataFrame operators."""
