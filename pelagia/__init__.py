"""Pelagia: a PySpark-native analytics engine for very large media catalogs."""
