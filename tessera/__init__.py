"""A PySpark-native engine for multimodal knowledge cores and training-data preparation."""
