"""Endpoint functions and the catalogue of registered queries."""
