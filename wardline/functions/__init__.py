"""Column functions: PostgreSQL-compatible scalars, planar geometry, access predicates."""
