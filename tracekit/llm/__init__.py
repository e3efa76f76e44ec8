"""Training-data operators: one module per operator, thin ``opN_*`` queries in ``queries``."""
