"""Scalar expressions, all native unless a docstring says otherwise."""
