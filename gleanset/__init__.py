"""Labelled text-dataset curation and label evaluation on Spark."""
