"""Readers that hand the domain tables to the operators."""
