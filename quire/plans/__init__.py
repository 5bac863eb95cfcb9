"""What is compiled on the driver: models, templates, predicates, addresses."""
