"""gridloom: a Spark-native engine for columns over indexed domains."""
