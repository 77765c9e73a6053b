"""Long-form text to searchable, graph-structured context, as DataFrame transformations."""
