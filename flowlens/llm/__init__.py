"""Operators for preparing text and vectors at corpus scale. Nothing else in the package imports them."""
