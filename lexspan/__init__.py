"""Spark-native engine for hierarchical legal texts: catalogs, code trees, phrase search, citations, change sets."""
