"""The operators: building and managing a graph, querying it, and answering questions over it."""
