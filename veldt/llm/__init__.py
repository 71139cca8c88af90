"""Training-data operators.  Nothing outside this folder imports it (the query
registry adds it only when present)."""
