"""Spark-native analytics over agent traces, evaluation results and training corpora."""
