"""textmill: a Spark-native engine for bilingual text corpora and assistant data."""
