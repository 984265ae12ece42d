"""Column-to-Column functions; none of them is a UDF."""
