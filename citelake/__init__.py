"""citelake: a PySpark-native engine for bibliographic analytics and training-data work."""
