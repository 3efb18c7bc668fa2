"""What the text operators share: word rules, row places, wide joins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.session import materialize

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def located(docs: DataFrame) -> DataFrame:
    """Each row as ``doc`` (all its columns) with its place: ``file`` and ``row``.

    The place is the identity of a row where ids repeat or are null. It comes from
    the Parquet scan; rows from anywhere else are written to the work folder first.
    """
    try:
        return _located(docs)
    except AnalysisException:
        return _located(materialize(docs, "landed"))


def _located(docs: DataFrame) -> DataFrame:
    meta = docs.metadataColumn("_metadata")
    out = docs.select(
        F.struct(*[quoted(c) for c in docs.columns]).alias("doc"),
        meta["file_path"].alias("file"),
        meta["row_index"].alias("row"),
    )
    out.schema  # resolves now, so that a source without row places is seen here
    return out


def field(df: DataFrame, name: str) -> Column:
    """A column of the document kept by :func:`located`; null where it has none."""
    if name in df.schema["doc"].dataType.fieldNames():
        return F.col("doc")[name]
    return F.lit(None)


def keep_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``docs`` at ``places`` (file, row), with exactly the columns of ``docs``."""
    return docs.join(places.select("file", "row"), ["file", "row"], "left_semi").select("doc.*")


def id_key(doc_id: Column) -> Column:
    """Text of an id for hashing; null is a value of its own."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def held(doc_id: Column, parts: int, part: int) -> Column:
    """Whether ``crc32`` of the id's text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(id_key(doc_id).cast("binary")) % parts == part


FREQUENT = 4096  # keys that a spread join sends to every task, at most


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per key, stored) added, whatever the skew of the keys.

    ``weight`` is how many of ``rows`` have the key. Keys with more than 1/``FREQUENT`` of the weight, fewer than
    ``FREQUENT`` of them by that bound, are broadcast; a task of the remaining join gets no key
    with more. Rows already answered are dealt out there by their hash, where nothing matches them. No key is null.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in table.columns if c not in keys]
    often = F.col(weight) > total / FREQUENT
    frequent = table.filter(often).select(*keys, F.struct(*values).alias("_often"))
    seldom = table.filter(~often).select(*keys, F.lit(0).alias("_salt"), F.struct(*values).alias("_seldom"))
    known = rows.join(F.broadcast(frequent), keys, "left")
    spread = F.when(F.col("_often").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(FREQUENT)).cast("int"))
    both = known.withColumn("_salt", spread).join(seldom, [*keys, "_salt"], "left")
    found = F.coalesce("_often", "_seldom")
    if how == "inner":
        both = both.filter(found.isNotNull())
    return both.select(*rows.columns, *[found[c].alias(c) for c in values])
