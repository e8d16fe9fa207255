"""Readers of landed pages, responses and documents. Schemas are declared; nothing is inferred or collected."""
