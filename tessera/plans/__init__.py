"""Whole queries put together from functions and operators."""
