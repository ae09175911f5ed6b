"""Collection analytics for wearable biosignal recordings and spot readings, on Spark DataFrames."""
