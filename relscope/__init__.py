"""A Spark-native analytics engine for database catalogs and SQL scripts."""
