"""Operator 10: document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A paragraph is a line, cut after every 16 words; a document is the set of its paragraphs' 64-bit digests.  A
sketch has three equal subtables; a digest goes into one cell of each, and a cell holds a count, the xor of its digests and the xor of
their check values.  Two versions' sketches subtract cell by cell, so what both have cancels.  Peeling then takes
digests out of cells that hold a single one (count 1 or -1, check value right), subtable by subtable, as a digest stands once in
each, so no digest is taken out twice.  If every cell ends empty, what was taken out is exactly the
difference, and the likeness is the Jaccard similarity of the two sets.  If not, the pair is tried again with larger
sketches: first so large that even disjoint sets should peel, then twice as large each time, with new hash functions.

The fingerprint's own sketches are small, so they are made, subtracted and peeled inside their row: the first try moves nothing.
Larger ones are rows of cells; all rounds of a try run in one stage, as every grouping is by row and cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibspark.llm.common import checkpointed, text_or_empty

WORDS = 16
BASE = 8  # cells of each subtable of the fingerprint itself
TABLES = 3
PARTS = 256
SMALL_ROUNDS = 9  # of peeling a fingerprint's sketch
ROUNDS = 15  # of peeling a larger one


def digests_of(text: Column, words: int = WORDS) -> Column:
    """Distinct digests of the paragraphs of a text; white space around a paragraph doesn't count, a blank text has none."""
    found = F.regexp_extract_all(text, F.lit(r"((?:[^\s]+[^\S\n]*){1,%d})" % words), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(F.rtrim(p, F.lit(" \t\r\x0b\f")))))


def _cell(digest: str, table: int | str, size: int | str, seed: int | str) -> str:
    return f"cast({table} * {size} + pmod(xxhash64({digest}, {table}, {seed}), {size}) AS int)"


def sketch(digests: str, base: int = BASE) -> str:
    """Expression of the small sketch of an array of digests: an array of struct(c, k, h), a cell each."""
    entry = f"named_struct('k', d, 'h', hash(d), {', '.join(f"'t{t}', {_cell('d', t, base, 0)}" for t in range(TABLES))})"
    cell = "aggregate(filter(e, x -> x.t{t} = i), named_struct('c', 0, 'k', 0L, 'h', 0), (y, x) -> named_struct('c', y.c + 1, 'k', y.k ^ x.k, 'h', y.h ^ x.h))"
    tables = ", ".join(f"transform(sequence({t * base}, {(t + 1) * base - 1}), i -> {cell.format(t=t)})" for t in range(TABLES))
    return f"transform(array(transform({digests}, d -> {entry})), e -> concat({tables}))[0]"


def subtracted(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peeled(cells: str, base: int = BASE, rounds: int = SMALL_ROUNDS) -> str:
    """Expression of struct(cells, taken): what is left of a small sketch after so many rounds, and how many digests were taken out."""
    single = "abs(x.c) = 1 AND x.h = hash(x.k)"
    without = "aggregate(filter(p, x -> " + _cell("x.k", f"cast(i div {base} AS int)", base, 0) + " = i), z, (y, x) -> named_struct('c', y.c - x.c, 'k', y.k ^ x.k, 'h', y.h ^ x.h))"
    moved = f"transform(s.cells, (z, i) -> if(i div {base} = r % {TABLES}, if(exists(array(z), x -> {single}), named_struct('c', 0, 'k', 0L, 'h', 0), z), {without}))"
    pure = f"filter(slice(s.cells, (r % {TABLES}) * {base} + 1, {base}), x -> {single})"
    step = f"transform(array({pure}), p -> if(size(p) = 0, s, named_struct('cells', {moved}, 'taken', s.taken + size(p))))[0]"
    return f"aggregate(sequence(0, {rounds - 1}), named_struct('cells', {cells}, 'taken', 0), (s, r) -> {step})"


def small_difference(left: str, right: str, base: int = BASE) -> str:
    """Expression of the number of digests by which two sets differ, by their small sketches; null where the difference doesn't peel.

    Sets whose sizes (part of a fingerprint) alone tell that it can't aren't tried.
    """
    result = f"transform(array({peeled(subtracted(sketch(left, base), sketch(right, base)), base)}), s -> if(exists(s.cells, x -> x.c <> 0 OR x.k <> 0 OR x.h <> 0), null, s.taken))[0]"
    return f"if(abs(size({left}) - size({right})) <= {TABLES * base}, {result}, null)"


def cells(signed: DataFrame, by: list[str]) -> DataFrame:
    """Cells (cell, c, k, h) for each group `by` from rows (by, digests, sign, size, seed); of a signed pair, their difference.

    With sign 0 the digests are counts that are known already; they go to cell -1, where peeling counts too.
    """
    put = ", ".join(f"struct({_cell('d', t, 'size', 'seed')} AS cell, sign AS c, d AS k, hash(d) AS h)" for t in range(TABLES))
    spread = signed.select(*by, "sign", "size", "seed", F.explode("digests").alias("d"))
    return _merged(spread.select(*by, "size", "seed", F.expr(f"inline(if(sign = 0, array(struct(-1 AS cell, cast(d AS int) AS c, 0L AS k, 0 AS h)), array({put})))")), by)


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    out = rows.groupBy(*by, "size", "seed", "cell").agg(F.sum("c").cast("int").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return out.filter("cell < 0 OR c <> 0 OR k <> 0 OR h <> 0")


def peel(found: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """The cells that are left after so many rounds; a cell -1 counts the digests that were taken out."""
    for r in range(rounds):
        t = r % TABLES
        pure = f"abs(c) = 1 AND cell >= {t} * size AND cell < {t + 1} * size AND h = hash(k)"
        others = ", ".join(f"struct({_cell('k', o, 'size', 'seed')} AS cell, -c AS c, k AS k, h AS h)" for o in range(TABLES) if o != t)
        moved = F.expr(f"inline(if({pure}, array(struct(-1 AS cell, 1 AS c, 0L AS k, 0 AS h), {others}), array(struct(cell AS cell, c AS c, k AS k, h AS h))))")
        found = _merged(found.select(*by, "size", "seed", moved), by)
    return found


def fingerprint(digests: str, base: int = BASE) -> Column:
    """Text form: number of digests, then each cell that isn't empty as cell:count:digests:checks (hexadecimal)."""
    shown = f"transform({sketch(digests, base)}, (x, i) -> if(x.c = 0, null, concat(hex(i), ':', x.c, ':', lower(hex(x.k)), ':', lower(hex(cast(x.h AS bigint) & 4294967295)))))"
    return F.expr(f"concat_ws(';', cast(size({digests}) AS string), concat_ws(';', {shown}))")


def likeness(sets: DataFrame, kinds: dict[str, tuple[str, str]], *, base: int = BASE) -> DataFrame:
    """The columns of sets with one for each kind; kinds names the two arrays of digests to compare for each.

    A result is the Jaccard similarity of two sets by their sketches' peeled difference: 1 for two empty sets, 0 where just one is
    empty.  The column row is unique.  The fingerprint's own small sketches are tried first, inside each row; what they tell
    goes along as a count.  A larger try groups and joins by row, in place where the table is dealt out by row already,
    and ends in a checkpoint that keeps only arrays that are needed on.
    """
    names = list(kinds)
    open_ = " OR ".join(f"{n} IS NULL" for n in names)
    arrays = list(dict.fromkeys(c for pair in kinds.values() for c in pair))
    rows = sets.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    done, attempt = [], 1
    while True:
        small = lambda a, b: small_difference(a, b, base) if attempt == 1 else "cast(null AS int)"  # noqa: E731, B023
        pairs = ", ".join(f"struct({i} AS kind, {n} IS NULL AS tried, {small(a, b)} AS known, size({a}) + size({b}) AS total, {a} AS left_set, {b} AS right_set)" for i, (n, (a, b)) in enumerate(kinds.items()))
        dealt = rows.select("row", F.expr(f"inline(filter(array({pairs}), p -> p.tried))"))
        size = f"cast((ceil(total * 0.6) + 6) * {1 << (attempt - 1)} AS int)"
        sides = "array(struct(left_set AS digests, 1 AS sign), struct(right_set AS digests, -1 AS sign))"
        signed = dealt.select("row", "kind", F.expr(size).alias("size"), F.lit(attempt).alias("seed"), F.expr(f"inline(if(known IS NULL, {sides}, array(struct(array(cast(known AS bigint)) AS digests, 0 AS sign))))"))
        left = peel(cells(signed, ["row", "kind"]), ["row", "kind"], ROUNDS)
        got = left.groupBy("row").agg(*[x for i in range(len(kinds)) for x in (F.sum(F.expr(f"if(cell < 0 AND kind = {i}, c, 0)")).alias(f"taken_{i}"), F.count_if((F.col("cell") >= 0) & (F.col("kind") == i)).alias(f"left_{i}"))]).withColumnRenamed("row", "got_row")
        met = rows.join(got.hint("shuffle_hash"), F.col("row") == F.col("got_row"), "left")
        near = [F.expr(f"CASE WHEN {n} IS NOT NULL THEN {n} WHEN size({a}) + size({b}) = 0 THEN 1D WHEN coalesce(left_{i}, 0) = 0 THEN (size({a}) + size({b}) - coalesce(taken_{i}, 0)) / cast(size({a}) + size({b}) + coalesce(taken_{i}, 0) AS double) END").alias(n) for i, (n, (a, b)) in enumerate(kinds.items())]
        tried = met.select(*sets.columns, *near)
        # Arrays that only open pairs need end with them; the first two of the first kind are the fingerprints'.
        kept = [F.when(F.expr(" OR ".join([f"{n} IS NULL" for n, pair in kinds.items() if c in pair])), F.col(c)).otherwise(F.expr("cast(array() as array<bigint>)")).alias(c) if c in arrays and c not in kinds[names[0]] else F.col(c) for c in tried.columns]
        tried = checkpointed(tried.select(*kept))
        done.append(tried.filter(f"NOT ({open_})"))
        rows = tried.filter(open_)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        attempt += 1


def following(ids: DataFrame) -> DataFrame:
    """(id, next_id) for each different id that isn't null: the next smaller id, for the smallest the largest.

    Ids are cut into ranges at approximate quantiles, each range is ordered by itself, and the ranges' ends are joined, so
    no task orders the whole table.
    """
    ids = ids.filter("id IS NOT NULL").distinct()
    marks = ids.agg(F.percentile_approx("id", [i / PARTS for i in range(1, PARTS)], 10000).alias("q")).first()["q"] or []
    cut = F.array(*[F.lit(m) for m in sorted(set(marks))]) if marks else F.expr("cast(array() as array<long>)")
    parted = ids.withColumn("part", F.size(F.filter(cut, lambda m: m <= F.col("id"))))
    ends = parted.groupBy("part").agg(F.max("id").alias("top"))
    before = ends.select(F.col("part").alias("at"), F.coalesce(F.lag("top").over(W.orderBy("part")), F.max("top").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("fallback"))
    inner = parted.withColumn("below", F.lag("id").over(W.partitionBy("part").orderBy("id")))
    # At most PARTS rows are broadcast.
    return inner.join(F.broadcast(before), F.col("part") == F.col("at")).select("id", F.coalesce("below", "fallback").alias("next_id"))


def _versions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, n_chars, edited_sha256, own, new, next_set): the digests of each row's text, edited text and next document."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    counted = rows.select("id").groupBy("id").count()
    plain = counted.filter("id IS NULL OR count > 1").isEmpty()
    if plain:  # the rule: the key numbers the rows
        rows = rows.filter("id IS NOT NULL")
        number = F.col("id").alias("row")
    else:
        rows = checkpointed(rows.withColumn("number", F.monotonically_increasing_id()))
        number = F.col("number").alias("row")
    third = "cast(floor(length(text) / 3) as int)"
    order = checkpointed(following(rows.select("id")))
    wants = rows.select("id", F.expr(third).alias("k")).groupBy("id").agg(F.max("k").alias("k")).withColumnRenamed("id", "for_id").join(order.withColumnRenamed("id", "order_id"), F.col("for_id") == F.col("order_id")).select("next_id", "for_id", "k")
    heads = rows.join(wants, rows["id"] == wants["next_id"]).select("for_id", F.expr("substring(text, 1, k)").alias("head"), digests_of(F.col("text")).alias("next_set")).groupBy("for_id").agg(F.min("head").alias("head"), F.min("next_set").alias("next_set"))
    both = rows.join(heads, rows["id"] == heads["for_id"], "left")
    edited = F.concat(F.expr(f"substring(text, 1, length(text) - {third})"), F.expr(f"coalesce(substring(head, 1, {third}), '')"))
    nothing = F.expr("cast(array() as array<bigint>)")
    made = both.select(number, "id", F.length("text").cast("long").alias("n_chars"), digests_of(F.col("text")).alias("own"), edited.alias("edited"), F.coalesce("next_set", nothing).alias("next_set"))
    made = made.select("row", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", digests_of(F.col("edited")).alias("new"), "next_set")
    return made


def compare_versions(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each text and its edited form, and compare it with that and with the next document.

    Edited: the last third of the code points (rounded down) gives way to as many first ones of the next document in
    descending order of key (after the last: the first), or all of them.  Returns key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next for each row.  A null text counts as empty.  A row without a key has no next
    document: its last third goes, and near_next is the likeness to an empty text.  Rows with equal keys each have a result;
    as a next document the one with the least beginning and the least digest list stand for them.

    Texts are shuffled by key once: the same exchange serves as the source of the next documents' beginnings and as their target.
    """
    near = likeness(_versions(docs, key, text), {"near_edited": ("own", "new"), "near_next": ("own", "next_set")})
    return near.select(F.col("id").cast(docs.schema[key].dataType).alias(key), "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("new").alias("edited_fingerprint"), "near_edited", "near_next")
