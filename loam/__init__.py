"""loam: a Spark-native engine for building, querying and scoring document knowledge bases."""
