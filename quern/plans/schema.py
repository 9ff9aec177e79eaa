"""Schemas as text: CREATE TABLE statements in the order of references, and a manifest."""

from __future__ import annotations

import json

from ..errors import DefinitionError
from ..sources.entity import Entity


def creation_order(entities: list[type[Entity]]) -> list[type[Entity]]:
    """Referenced tables first; tables that refer to each other in a ring keep the order given among themselves."""
    by_table = {e.table: e for e in entities}
    needs = {e.table: {c.references.split(".")[0] for c in e.columns.values() if c.references} & set(by_table) - {e.table} for e in entities}
    out: list[str] = []
    while len(out) < len(by_table):
        ready = [t for t in by_table if t not in out and needs[t] <= set(out)]
        if not ready:  # a ring: take the table that waits for the fewest others
            ready = [min((t for t in by_table if t not in out), key=lambda t: (len(needs[t] - set(out)), list(by_table).index(t)))]
        out += ready
    return [by_table[t] for t in out]


def rings(entities: list[type[Entity]]) -> list[set[str]]:
    """Sets of tables that reach each other by references."""
    by_table = {e.table: e for e in entities}
    reach = {t: {c.references.split(".")[0] for c in e.columns.values() if c.references} & set(by_table) for t, e in by_table.items()}
    for k in by_table:
        for t in by_table:
            if k in reach[t]:
                reach[t] |= reach[k]
    found = []
    for t in by_table:
        ring = {o for o in by_table if o in reach[t] and t in reach[o]}
        if len(ring) > 1 and ring not in found:
            found.append(ring)
    return found


def ddl(entity: type[Entity], using: str = "parquet") -> str:
    """CREATE TABLE as Spark takes it; keys, references, uniqueness and checks, which it does not enforce, go to properties."""
    if entity.view:
        raise DefinitionError("view-is-read-only", f"{entity.__name__} is a view and has no table")
    columns = ",\n  ".join(f"`{c.name}` {c.spark_type.upper()}" + ("" if c.nullable and not c.key else " NOT NULL") for c in entity.columns.values())
    noted = {"quern.key": ",".join(k.name for k in entity.keys)}
    for c in entity.columns.values():
        for what in ("references", "check", "store_default", "computed", "on_delete"):
            if getattr(c, what):
                noted[f"quern.{what}.{c.name}"] = getattr(c, what)
        for what in ("unique", "indexed", "generated", "soft_delete", "token"):
            if getattr(c, what):
                noted[f"quern.{what}.{c.name}"] = "true"
    properties = ", ".join("'" + k + "' = '" + v.replace("'", "\\'") + "'" for k, v in noted.items())
    return f"CREATE TABLE `{entity.table}` (\n  {columns}\n) USING {using} TBLPROPERTIES ({properties})"


def manifest(entities: list[type[Entity]]) -> str:
    """All tables and views as JSON, in creation order."""
    tables = []
    for e in creation_order(entities):
        columns = [{"name": c.name, "type": c.spark_type, "nullable": c.nullable and not c.key, "key": c.key, "generated": c.generated, "computed": c.computed, "references": c.references, "unique": c.unique, "indexed": c.indexed} for c in e.columns.values()]
        tables.append({"name": e.table, "view": e.view, "columns": columns, "relations": sorted(e.relations)})
    return json.dumps({"version": 1, "tables": tables}, indent=1)
