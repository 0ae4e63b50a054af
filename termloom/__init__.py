"""termloom: a Spark-native engine for term retrieval, annotation and evaluation over text corpora."""
