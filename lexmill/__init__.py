"""lexmill: document de-identification and text analytics as PySpark DataFrame operators."""
