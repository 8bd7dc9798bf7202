"""Errors raised for input a job must not go on with."""

from __future__ import annotations


class DataValidationError(ValueError):
    """The input lacks required columns or values, or is of an unknown kind."""


class InsufficientDataError(ValueError):
    """There is too little data, or too little variety in it, to train a model."""
