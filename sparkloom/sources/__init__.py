"""Reading entities and shaping them into searchable documents."""
