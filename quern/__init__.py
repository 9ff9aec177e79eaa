"""Quern: declared entities and stores whose operations are lazy Spark DataFrames."""

from .errors import ConcurrencyConflict, DefinitionError, FilterValueMissing, QuernError, StoreError
from .functions.filters import GlobalFilter, filter_scope
from .functions.predicates import Compare, Where
from .plans.store import Store
from .sources.entity import AdHoc, BelongsTo, Column, Converter, Entity, HasMany, ManyToMany, Projection, as_json, as_name
from .sources.states import StateTables
from .sources.tables import FrameTables, ParquetTables

__all__ = [
    "AdHoc", "BelongsTo", "Column", "Compare", "ConcurrencyConflict", "Converter", "DefinitionError", "Entity", "FilterValueMissing", "FrameTables",
    "GlobalFilter", "HasMany", "ManyToMany", "ParquetTables", "Projection", "QuernError", "StateTables", "Store", "StoreError", "Where", "as_json", "as_name", "filter_scope",
]
