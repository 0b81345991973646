"""Spark-native engine for irregular daily price series and their audit trail."""
