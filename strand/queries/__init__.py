"""Registered queries, by subject. Importing the modules fills the registry."""

from strand.queries import coref, entities, functions, models, passages, threads  # noqa: F401
