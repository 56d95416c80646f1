"""Reading source tables, and the layout in which a graph is stored."""
