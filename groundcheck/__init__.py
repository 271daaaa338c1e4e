"""Spark-native measurement of how well the claims in long answers are grounded in the sources they cite."""
