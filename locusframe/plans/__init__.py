"""Query catalogue: each query with its SQL twin where one exists."""
