"""variantlake: multi-source record integration, release versioning and search on Spark DataFrames."""
