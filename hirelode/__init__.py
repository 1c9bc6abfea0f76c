"""Posting intelligence on Spark: operators over job-posting data."""
