"""A PySpark-native analytics engine with language-model operators over ordinary Spark SQL."""
