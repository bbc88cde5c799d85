"""Spark-native labelling and evaluation of text."""
