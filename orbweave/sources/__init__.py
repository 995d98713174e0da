"""Edge lists and results in files: text, packed binary, Parquet, DOT, benchmark logs."""
