"""PySpark operators for large labelled-media corpora; every operator is DataFrame -> DataFrame."""
