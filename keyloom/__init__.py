"""Spark-native dictionary building, word suggestion, spell checking and text-corpus operators."""
