"""featlens: Spark-native profiling, association statistics, feature engineering,
rate analytics and model comparison over DataFrames."""

__version__ = "0.1.0"
