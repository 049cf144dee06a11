"""Analytics for legal document production, and training-data preparation, on Spark."""
