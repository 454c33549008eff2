"""Evidence retrieval and grounding over whole tables, as PySpark DataFrame operators."""
