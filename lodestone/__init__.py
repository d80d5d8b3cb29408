"""lodestone: a Spark-native analytics, retrieval and corpus-processing engine."""
