"""Readers: logs, scrapes, polls, device samples, model manifests."""
