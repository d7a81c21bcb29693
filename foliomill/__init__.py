"""foliomill: a Spark-native analytics engine for semi-structured business documents."""
