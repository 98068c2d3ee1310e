"""glossa: a PySpark-native language-identification and text-processing engine."""
