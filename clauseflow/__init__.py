"""Spark-native operators for comparing two versions of a body of structured documents."""
