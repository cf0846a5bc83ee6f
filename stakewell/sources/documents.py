"""Stored states of any version as VARIANT documents, brought to the present one step after another.

Nothing is cast to a fixed shape before a document is known to be good, and what a version adds or lacks is no error: fields
are looked up by path where they are used, and what isn't known stays in the ticket's variant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import STATE_VERSION


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _as_object(text: Column) -> Column:
    """Version 0, a bare list of tickets, as a document of version 1."""
    return F.when(F.ltrim(text).startswith("["), F.concat(F.lit('{"version":1,"updatedAt":"","bets":'), text, F.lit("}"))).otherwise(text)


#: The step that leads away from a version, on a document's text.
UPGRADES: dict[int, Callable[[Column], Column]] = {0: _as_object}


def read_documents(docs: DataFrame, text: str = "value", present: int = STATE_VERSION, upgrades: dict[int, Callable[[Column], Column]] | None = None) -> DataFrame:
    """docs with status (ok, upgraded, newer, shape, corrupt, missing), was (the version found) and doc (the present document, null unless ok or upgraded).

    A bare list is version 0. A document needs a version, updatedAt and a list of tickets that all have an id and a stake.
    Steps run from a document's version to the present; a version without a step stays as it is and counts as the next.
    """
    upgrades = UPGRADES if upgrades is None else upgrades
    said = F.col(text)
    out = docs.withColumn("doc", F.try_parse_json(F.when(F.trim(said) != "", said)))
    is_list = F.coalesce(F.schema_of_variant("doc").startswith("ARRAY"), F.lit(False))
    was = F.when(is_list, 0).otherwise(_get(F.col("doc"), "$.version", "int"))
    out = out.withColumns({"was": was, "parsed_": F.col("doc").isNotNull(), "now_": said})
    for version in range(present):
        if version in upgrades:
            out = out.withColumn("now_", F.when(F.col("was") <= version, upgrades[version](F.col("now_"))).otherwise(F.col("now_")))
    out = out.withColumn("doc", F.try_parse_json("now_"))
    bets = _get(F.col("doc"), "$.bets", "array<variant>")
    good = F.coalesce(F.forall(bets, lambda b: _get(b, "$.id", "string").isNotNull() & _get(b, "$.stake", "string").isNotNull()), F.lit(False))
    good = good & F.col("was").isNotNull() & _get(F.col("doc"), "$.updatedAt", "string").isNotNull()
    status = F.when(F.trim(F.coalesce(said, F.lit(""))) == "", "missing").when(~F.col("parsed_"), "corrupt").when(~good, "shape").when(F.col("was") > present, "newer").when(F.col("was") < present, "upgraded").otherwise("ok")
    out = out.withColumn("status", status).drop("parsed_", "now_")
    return out.withColumn("doc", F.when(F.col("status").isin("ok", "upgraded"), F.col("doc")))


def tickets_of(docs: DataFrame, **fields: str) -> DataFrame:
    """One row a ticket of the usable documents: the document's other columns, `fields` {name: 'path:type'}, and rest, the whole ticket."""
    other = [c for c in docs.columns if c != "doc"]
    rows = docs.where(F.col("doc").isNotNull()).select(*other, F.explode(_get(F.col("doc"), "$.bets", "array<variant>")).alias("rest"))
    return rows.select(*other, *(_get(F.col("rest"), f"$.{p.split(':')[0]}", p.split(":")[1]).alias(n) for n, p in fields.items()), "rest")
