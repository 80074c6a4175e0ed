"""loomstone: a Spark-native engine that moves large columnar tables to a new schema part by part."""
