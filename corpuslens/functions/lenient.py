"""JSON read into a fixed shape member by member, so that one member of another type costs nothing else.

Members are read as text first.  A number in quotes is that number, a fraction loses its
fraction where a whole number is wanted, one value where a list is wanted is a list of
one, and a text where an object is wanted is the object's `name`.  What has no reading
is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(text: Column, shape: T.DataType) -> Column:
    """`text` as a value of `shape`; members are whole numbers, texts, lists and objects of these."""
    if isinstance(shape, T.StructType):
        return _object(text, shape)
    if isinstance(shape, T.ArrayType):
        listed = F.from_json(text, "array<string>")
        one = F.when(text.isNotNull(), F.array(text))
        if isinstance(shape.elementType, T.StringType):
            return F.when(_is(text, r"\["), F.coalesce(listed, one)).otherwise(one)
        return F.transform(F.when(_is(text, r"\["), listed).otherwise(one), lambda e: read_json(e, shape.elementType))
    if isinstance(shape, T.StringType):
        return text
    return F.coalesce(text.try_cast(shape), text.try_cast("double").try_cast(shape))


def _is(text: Column, first: str) -> Column:
    return text.rlike(rf"^\s*{first}")


def _object(text: Column, shape: T.StructType) -> Column:
    members = F.from_json(text, T.StructType([T.StructField(f.name, T.StringType()) for f in shape.fields]))
    read = F.struct(*[read_json(members[f.name], f.dataType).alias(f.name) for f in shape.fields])
    value = F.when(_is(text, r"\{"), read)
    if "name" in shape.names:
        named = F.struct(*[(text if f.name == "name" else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
        value = value.when(text.isNotNull() & ~_is(text, r"\["), named)
    return value
