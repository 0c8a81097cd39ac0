"""isochron: sensor-timing analytics on Spark DataFrames."""
