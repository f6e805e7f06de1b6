"""Registered queries. Importing a module here registers what it defines."""

from parcelwise.plans import choices, evidence, intake, modelling, orders, scores  # noqa: F401
