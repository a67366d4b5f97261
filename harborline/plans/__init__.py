"""Whole models, their fixed parameters, and the registered queries with their SQL oracles."""
