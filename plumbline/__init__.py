"""plumbline: a Spark-native engine for parcel and sale analytics."""
