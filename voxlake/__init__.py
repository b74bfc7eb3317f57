"""PySpark-native engine for collections of multi-channel 3-D volumes."""
