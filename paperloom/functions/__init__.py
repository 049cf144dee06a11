"""Column functions: paths, labels, dates, and pattern matches. All are built from SQL functions."""
