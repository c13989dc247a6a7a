"""tapework: Spark jobs for open/high/low/close/volume time series."""
