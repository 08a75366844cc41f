"""Plumbline: a Spark-native engine for measuring automated judges.

Everything relational takes and returns DataFrames; nothing starts a session.
"""
