"""A run's tables, its metadata and its queries."""

from .model import Database, ElementSet, MeshClass, Parameter, StateRecord, Subrecord, Variable
from .query import query

__all__ = ["Database", "ElementSet", "MeshClass", "Parameter", "StateRecord", "Subrecord", "Variable", "query"]
