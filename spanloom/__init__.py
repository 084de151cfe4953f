"""Part of spanloom, a Spark-native engine for lexical and prototype-based text retrieval."""
