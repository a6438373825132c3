"""JSON of any shape, read once into Spark's variant type.

A variant keeps the kinds its fields have: a field may be a number in one row, a text or an
object in the next. It is parsed once, and fields are taken from its binary form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column | str) -> Column:
    """JSON as a variant; null where it is none, or null."""
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def field(variant: Column, path: str, kind: str) -> Column:
    """The field at ``path`` (``$.a.b[0]``) as a ``kind``.

    Null where there is none, where it is JSON's null, or where it is nothing of the kind:
    a number as text is its digits, a text as number is read, an object is neither.
    """
    return F.try_variant_get(variant, path, kind)


def kind(variant: Column, path: str = "$") -> Column:
    """Of what kind a field is, as Spark names types; null where there is none.

    JSON's null is of kind VOID; arrays and objects are ARRAY<...> and OBJECT<...>.
    """
    found = F.try_variant_get(variant, path, "variant")
    return F.when(found.isNotNull(), F.schema_of_variant(found))
