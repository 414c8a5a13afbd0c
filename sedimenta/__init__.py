"""Sedimenta: a PySpark-native engine that refines raw pages and documents into a clean corpus."""
