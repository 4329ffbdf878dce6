"""Search and mining of document corpora as sequences of bytes, on Spark."""
