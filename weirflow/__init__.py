"""PySpark-native analytics for short texts, their labels and the time series around them."""
