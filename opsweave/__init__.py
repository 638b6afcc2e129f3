"""A Spark library for the operational record of model servers."""
