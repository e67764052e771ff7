"""voxframe: a PySpark-native engine for speech corpora and training text."""
