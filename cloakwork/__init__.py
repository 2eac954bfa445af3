"""Detection and redaction of personal data in document collections, on Spark."""
