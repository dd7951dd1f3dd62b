"""wattline: DataFrame operators for energy time series on Apache Spark."""
