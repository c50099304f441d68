"""What queries are made of: predicates, scoring, phrases, facets, matching, sorting, highlights."""
