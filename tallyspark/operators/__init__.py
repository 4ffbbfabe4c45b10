"""Table operations: DataFrame to DataFrame."""
