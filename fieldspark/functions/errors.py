"""Errors of queries and accessors, raised on the driver."""

from __future__ import annotations

from .names import QueryError


class UnknownName(QueryError):
    """A result that no dictionary holds."""


class UnknownClass(QueryError):
    """A class that the mesh does not have."""


class NoSubrecord(QueryError):
    """A result that the class does not carry, or no subrecord of the name that was asked for."""


class LabelNotFound(QueryError):
    """None of the labels asked for is in the class. Single ones that are not are dropped silently."""


class StateOutOfRange(QueryError):
    """A state beyond the run's."""


class UnknownMaterial(QueryError):
    """A material that the class does not have."""


class PointOutOfRange(QueryError):
    """An integration point that the element set does not have."""


class InvalidSubscript(QueryError):
    """A subscript of the wrong rank or out of its dimension."""


class SubscriptNotApplicable(QueryError):
    """A subscript on a result that has no dimensions or components."""


class InconsistentPoints(QueryError):
    """Elements of one query with different numbers of integration points, and no points named."""


class FragmentMismatch(QueryError):
    """Fragments whose time axis, type or arity differ."""


class Unsupported(QueryError, NotImplementedError):
    """A combination that is not defined."""
