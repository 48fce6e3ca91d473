"""Scalar functions, as column expressions and as plain Python where the driver needs them."""
