"""Text-dataset curation and evaluation on Spark."""
