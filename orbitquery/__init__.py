"""A PySpark-native engine for image retrieval, geolocation and corpus preparation."""
