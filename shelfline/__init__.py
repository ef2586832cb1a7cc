"""shelfline: Spark-native retail analytics marts, panel forecasting and text routing."""
