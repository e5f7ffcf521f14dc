"""Table operators: DataFrame in, DataFrame (or a bounded result) out."""
