"""Spark-native engine for finding, redacting and scoring personal data in text and chat payloads."""
