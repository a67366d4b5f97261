"""Readers for ticket tables and the writer for results."""
