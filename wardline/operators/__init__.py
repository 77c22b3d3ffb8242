"""DataFrame operators: relational surface, security, catalogue, semantics, screening."""
