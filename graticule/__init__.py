"""Spark-first analytics over labelled images: scan, encode, match, learn, evaluate, report."""
