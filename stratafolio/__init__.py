"""A PySpark-native engine for versioned collections of research documents."""
