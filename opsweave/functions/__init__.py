"""Column builders: durations, classes, histograms, percentile ranks, buckets, log patterns."""
