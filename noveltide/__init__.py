"""A PySpark-native engine for scientometrics: from harvested records to a semantic novelty index."""
