"""A PySpark-native engine for web-crawl analytics and corpus preparation."""
