"""Check queries: every operator on tables derived from the driver's data, with its SQL twin."""
