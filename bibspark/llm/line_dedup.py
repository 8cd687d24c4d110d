"""Operator 9: line dedup over windows of three consecutive lines.

Every window is hashed to 128 bits where its document is read.  The first occurrence of a hash, by document and
position, owns it; a window that isn't its hash's owner is a later occurrence, and the lines that later
occurrences cover go (their positions are merged, so overlaps count once).  What travels back to a document is
which of its windows own their hash: one row for each different hash, so a window that fills a third of the
table weighs as much as a rare one, and no join runs on hashes.  A document all of whose windows are owned, the usual
case, is left as it stands without hashing its lines again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = 3
LOW = 0xFFFFFFFF
INSIDE = ["name_a", "name_b", "text_hash", "owned", "found"]


def _windows(lines: str, size: int, made: str) -> str:
    """Array with `made` for each window of the array `lines`, in which i is its position and {h1}, {h2} are its hash's halves."""
    parts = ", ".join(f"{lines}[i + {k}]" for k in range(size))
    each = made.format(h1=f"xxhash64({parts})", h2=f"xxhash64(7, {parts})", mark=f"(xxhash64({parts}) & -4294967296L) | i")
    return f"transform(sequence(0, size({lines}) - {size}), i -> {each})"


def _of_lines(text: str, made: str) -> str:
    """`made` with l for the text's lines, which are cut once."""
    return f"transform(array(split({text}, '\\n', -1)), l -> {made})[0]"


def _once(values: Column) -> Column:
    """The struct's fields as columns, worked out once for each row: filters and projections above can't be merged into a generator."""
    return F.inline(F.array(values))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """docs with n_lines, n_removed and kept_text (the lines that stay, joined by line feeds; null where text is null).

    Lines end at a line feed and are compared as they stand.  A document of fewer than `lines` lines has no
    window and keeps all; a null text has no lines.  Documents are in the order of key, null first; of rows with equal keys
    the text of smaller hash (xxhash64) is earlier, and rows equal in both are one document with one result.
    Documents meet their owned windows by key and text, so a null or repeated key gathers nothing.
    """
    docs = docs.drop("n_lines", "n_removed", "kept_text", *INSIDE)
    quoted = f"`{text}`"
    own = docs.columns
    # One shuffle of the texts, by a 128-bit name of key and text; windows are read from it, and what they own comes back to it.
    # Both sides use the same columns of a table of key and text, so they share the exchange; other columns make the join's own.
    rows = docs.withColumns({"text_hash": F.xxhash64(text), "name_a": F.xxhash64(key, text), "name_b": F.xxhash64(F.lit(7), key, text)}).repartition("name_a", "name_b", "text_hash")
    hashed = _of_lines(quoted, f"if(size(l) < {lines}, null, {_windows('l', lines, 'struct({mark} AS mark, {h1} AS h1, {h2} AS h2)')})")
    windows = rows.select(F.col(key).alias("key"), "text_hash", "name_a", "name_b", F.inline(F.expr(hashed)))  # only hashes leave the row that holds the lines
    first = F.min(F.struct("key", "text_hash", F.col("mark").bitwiseAND(F.lit(LOW)).alias("pos"), "mark", "name_a", "name_b"))
    owners = windows.groupBy("h1", "h2").agg(first.alias("own")).select("own.name_a", "own.name_b", "own.text_hash", "own.mark")
    owned = owners.groupBy("name_a", "name_b", "text_hash").agg(F.collect_list("mark").alias("owned"))
    # The side of numbers is hashed: texts stream through the join unsorted.
    met = rows.join(owned.hint("shuffle_hash"), ["name_a", "name_b", "text_hash"], "left")
    later = f"transform(array_except({_windows('l', lines, '{mark}')}, coalesce(owned, cast(array() as array<bigint>))), m -> cast(m & {LOW} AS int))"
    covered = f"array_distinct(flatten(transform({later}, p -> sequence(p, p + {lines - 1}))))"
    kept = "array_join(transform(array_except(sequence(0, size(l) - 1), c), i -> l[i]), '\\n')"
    removed = f"transform(array({covered}), c -> named_struct('n_lines', size(l), 'n_removed', size(c), 'kept_text', {kept}))[0]"
    whole = f"size(l) < {lines} OR coalesce(size(owned), 0) = size(l) - {lines - 1}"
    found = _of_lines(quoted, f"if({whole}, named_struct('n_lines', size(l), 'n_removed', 0, 'kept_text', {quoted}), {removed})")
    none = f"named_struct('n_lines', 0, 'n_removed', 0, 'kept_text', {quoted})"
    return met.select(*own, _once(F.expr(f"if({quoted} IS NULL, {none}, {found})")))


def digests(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB; {docs} is the table or subquery of documents.
SQL = """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {docs} WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, len(lines) AS n FROM cut),
windows AS (
  SELECT doc_id, pos, n, line AS a,
    lead(line, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS b,
    lead(line, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS c
  FROM numbered),
marked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) > 1 AS later
  FROM windows WHERE pos + 3 <= n),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM marked, (SELECT unnest(range(3)) AS k) WHERE later),
result AS (
  SELECT n.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
    coalesce(string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE c.pos IS NULL), '') AS kept_text
  FROM numbered n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.pos = c.pos GROUP BY n.doc_id)
"""
SQL_DIGESTS = SQL.format(docs="documents") + "SELECT doc_id, n_lines, n_removed, sha256(kept_text) AS kept_sha256 FROM result"
