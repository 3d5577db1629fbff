"""quillspark: a Spark-native engine for building and checking language-model training data."""
