"""Conversation archiving and training-data preparation as Spark DataFrame operations."""
