"""Streaming use of models."""
