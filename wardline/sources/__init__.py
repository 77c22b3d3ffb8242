"""Reading datasets, catalogue and lineage documents; schema introspection; sinks."""
