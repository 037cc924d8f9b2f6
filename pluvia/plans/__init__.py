"""Whole tables built from operators."""
