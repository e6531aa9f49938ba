"""Evidence-screening analytics on Spark."""
