"""Facades that bundle operators."""
