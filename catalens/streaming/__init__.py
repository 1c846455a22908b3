"""Structured Streaming forms of the activity, badge and log jobs."""
