"""Line deduplication: lines that many documents share stay in one of them only.

Texts are cut at ``\\n`` and exploded. A line's key is the line without white space
(``[\\x20\\x09-\\x0D]``) at its ends, A-Z lower-cased; keys of at least ``least_chars`` code
points are hashed (SHA-256). Per hash the distinct documents are counted; where there are
``least_docs`` or more, the line goes from every document except the one with the largest id
that holds it, however often it stands there. What stays is put together again by position.

Only hashes, ids and positions are exploded and move. A hash is counted in two steps, per
document and then over documents, both with partial sums before the exchange, so that a line
of every document costs a task one row. Lines look their hash up by :func:`join_spread`: the
few most frequent hashes are sent to all tasks, the others are joined. Texts move at most once,
and only where lines go from too many documents to send their positions along.

A null text counts as empty, and an empty text is one empty line. Rows that share an id, or all
rows without one, are one document to the count, and a null id is below all others; every row
is rewritten on its own. Ids may be of any orderable type. Empty tables give no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import field, join_spread, located
from panelweave.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCS = 5


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; text without other letters takes the built-in way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _keyed(rows: DataFrame, text: Column, least_chars: int) -> DataFrame:
    """``(file, row, id, pos, hash)`` of each line long enough to count."""
    lines = rows.select("file", "row", "id", F.posexplode(lines_of(text)).alias("pos", "line"))
    trimmed = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.char_length("line") >= least_chars)
    return trimmed.select("file", "row", "id", "pos", F.unhex(F.sha2(lower_ascii(F.col("line")).cast("binary"), 256)).alias("hash"))


def line_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """Each row as ``doc`` with ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    rows = located(docs)
    rows = rows.withColumn("id", field(rows, doc_id))
    body = field(rows, text)
    keyed = materialize(_keyed(rows, body, least_chars), "line_keys")
    per_doc = keyed.groupBy("hash", "id").agg(F.count("*").alias("times"))
    shared = per_doc.groupBy("hash").agg(F.count("*").alias("docs"), F.max("id").alias("keeper"), F.sum("times").alias("times"))
    shared = materialize(shared.filter(F.col("docs") >= least_docs), "shared_lines")
    gone = join_spread(keyed, shared, ["hash"], "times").filter(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("file", "row").agg(F.sort_array(F.collect_list("pos")).alias("gone"))

    lines = lines_of(F.col("body"))
    out = rows.select("doc", "file", "row", body.cast("string").alias("body")).join(gone, ["file", "row"], "left")
    n_gone = F.coalesce(F.size("gone"), F.lit(0))
    return out.select(
        "doc",
        F.size(lines).cast("bigint").alias("n_lines"),
        n_gone.cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("body", F.lit(""))).otherwise(_without(lines, F.col("gone"))).alias("kept"),
    )


def _without(lines: Column, gone: Column) -> Column:
    """The lines between the sorted positions ``gone``, joined; linear in the lines."""
    ends = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.array_join(F.flatten(runs), "\n")


def deduped_rows(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` with their columns, ``text`` without the lines that go."""
    found = line_dedup(docs, text, **settings)
    return found.select(*[F.col("kept").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])


def line_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` per row."""
    return line_dedup(docs).select(F.col("doc.doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
