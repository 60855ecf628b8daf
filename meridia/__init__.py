"""Spark-native point-in-time credit analytics and corpus operators."""
