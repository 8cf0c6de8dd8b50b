"""Vector search by sketches and quantized projections, on Spark DataFrames."""
