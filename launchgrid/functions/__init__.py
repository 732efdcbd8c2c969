"""Column helpers and ordered statistics that stay distributed on hot groups."""
