"""DataFrame → DataFrame operators and model fitting."""
