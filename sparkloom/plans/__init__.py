"""From requests to plans: parameters, the query language, and the query families."""
