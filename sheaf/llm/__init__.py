"""Operators for large text corpora (training-data preparation).

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its
queries only when the folder is present."""
