"""Spark-native audit, split, sampling and evaluation of labelled media corpora."""
