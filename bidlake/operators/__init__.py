"""Set-level operators: DataFrame in, DataFrame out, lazy."""
