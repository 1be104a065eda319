"""tonearm: music-library analytics expressed with Spark DataFrames."""
