"""corpusloom: a Spark-native engine for building and auditing text corpora."""
