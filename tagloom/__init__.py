"""tagloom: record linkage and tag-metadata analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
