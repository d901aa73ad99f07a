"""ledgermill: Spark-native analytics for statements and transactions."""
