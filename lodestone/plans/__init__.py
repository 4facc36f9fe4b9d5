"""Registered queries over the standard tables; importing the package registers them."""

from lodestone.plans import corpus, coverage, grading, questions, retrieval, versions  # noqa: F401
