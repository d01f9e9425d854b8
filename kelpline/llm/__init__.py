"""Training-data operators: one module per operator, ``queries`` holds the thin query layer."""
