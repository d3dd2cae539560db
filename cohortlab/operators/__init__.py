"""DataFrame -> DataFrame operators of the study, one module per concern."""
