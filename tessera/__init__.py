"""Tessera: a Spark-native engine for document knowledge bases.

Documents are parsed into sections, cut into chunks, indexed for sparse and dense
retrieval in immutable snapshots, and searched in batches of queries.
"""
