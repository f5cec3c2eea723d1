"""Training-data operators: one module per operator, its query beside it."""
