"""textloom: document retrieval, calibrated decisions and corpus preparation on Spark."""
