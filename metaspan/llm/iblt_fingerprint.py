"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs (its lines that are not empty, as a set) are hashed to 64-bit digests. A sketch is a table of cells;
each digest lies in one cell of each of TABLES subtables, and a cell keeps the number, the XOR of digests and the XOR of
their check hashes. Sketches of one size subtract cell by cell, which leaves the digests of the symmetric difference.
Peeling then takes a cell that holds one digest (its number is 1 or -1 and the check hash agrees), notes the digest, and
removes it from its other cells, until all are empty. If cells stay filled, the sketch was too small for the difference:
both texts are sketched again larger, at first as large as the numbers in the cells make likely to do, then twice that and
so on. A larger sketch is a row of small ones, chosen by the leading bits of the digest, so the work is in proportion to
the digests.

The fingerprint is the base sketch (no leading bits) as text; equal texts have equal ones. likeness is the Jaccard
similarity |A & B| / |A | B| of the two paragraph sets, whose difference peeling has counted; two empty texts have 1.

Neighbours in descending order of ids are found without a global sort in one task: ids are cut into ranges by their
quantiles, rows are ordered inside a range, and each range's top row is also sent to the range above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaspan.llm.scratch import table

TABLES, WIDTH = 3, 4
CELLS = TABLES * WIDTH
#: Leading bits of the retries: sketches of 2, 4, 8, ... times the base; the last leaves a digest alone in its part.
BITS = list(range(1, 45))
#: Rounds of peeling; a part that needs more counts as failed and is retried larger.
ROUNDS = 8
#: Rows of a range on average, quantiles taken, and the ranges up to which their tops are broadcast (16 bytes each).
RANGE_ROWS, QUANTILES, BROADCAST_TOPS = 256, 256, 200_000


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text in order; the lowest bit is left for a side mark."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(lines, lambda p: F.shiftleft(F.shiftright(F.xxhash64(p), 1), 1))))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.alias("key"), check.alias("check"))


def _lies_in(key: Column, cell: Column) -> Column:
    """Whether the digest's place in the cell's subtable is the cell (whole-number operations only: this is the inner loop)."""
    by = F.shiftright(cell, 2) * 8 + 4
    return F.call_function("shiftrightunsigned", key, by).bitwiseAND(F.lit(WIDTH - 1).cast("bigint")) == cell.bitwiseAND(F.lit(WIDTH - 1)).cast("bigint")


def sketch(marked: Column) -> Column:
    """CELLS cells of marked digests: the lowest bit 0 adds, 1 subtracts."""
    zero = F.lit(0).cast("bigint")

    def put(acc: Column, d: Column) -> Column:
        side = d.bitwiseAND(F.lit(1))
        key = d - side
        return _cell(acc["n"] + 1 - 2 * side, acc["key"].bitwiseXOR(key), acc["check"].bitwiseXOR(_check(key)))

    def one(cell: int) -> Column:
        at, by = cell % WIDTH, cell // WIDTH * 8 + 4
        mine = F.filter(marked, lambda d: F.shiftrightunsigned(d, by).bitwiseAND(F.lit(WIDTH - 1).cast("bigint")) == F.lit(at).cast("bigint"))
        return F.aggregate(mine, _cell(F.lit(0), zero, zero), put)

    return F.array(*[one(c) for c in range(CELLS)])


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell, of two sketches of one size."""
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def peel(cells: Column) -> Column:
    """Digests recovered from one sketch of a difference, or null where cells stay filled."""
    state = lambda c, n, on: F.struct(c.alias("cells"), n.alias("found"), on.alias("on"))

    def once(acc: Column, _: Column) -> Column:
        single = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"])))
        pure = F.array_distinct(single)

        def remove(pure: Column) -> Column:
            def clear(cell: Column, i: Column) -> Column:
                here = F.filter(pure, lambda q: _lies_in(q["key"], i))
                return F.aggregate(here, cell, lambda x, q: _cell(x["n"] - q["n"], x["key"].bitwiseXOR(q["key"]), x["check"].bitwiseXOR(q["check"])))

            return state(F.transform(acc["cells"], clear), (acc["found"] + F.size(pure)).cast("int"), F.lit(True))

        # a one-element array names the list of pure cells, so that it is worked out once
        then = F.element_at(F.transform(F.array(pure), lambda p: F.when(F.size(p) > 0, remove(p)).otherwise(state(acc["cells"], acc["found"], F.lit(False)))), 1)
        return F.when(acc["on"], then).otherwise(acc)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, F.lit(0), F.lit(True)), once, lambda acc: F.when(F.forall(acc["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)), acc["found"]))
    return end


def _retry(marked: Column, bits: Column) -> Column:
    """Peel a larger sketch: parts by the leading bits of ordered, marked digests (a column); null if any part fails."""
    part = lambda d: F.call_function("shiftright", d, (F.lit(64) - bits).cast("int"))
    places = F.sequence(F.lit(1), F.size(marked))
    heads = F.filter(places, lambda i: (i == 1) | (part(F.element_at(marked, i)) != part(F.element_at(marked, F.greatest(i - 1, F.lit(1))))))
    ends = F.concat(F.slice(heads, 2, F.size(heads)), F.array(F.size(marked) + 1))
    pieces = F.zip_with(heads, ends, lambda a, b: F.slice(marked, a, b - a))
    return F.aggregate(pieces, F.lit(0), lambda acc, p: F.when(acc.isNotNull(), acc + peel(sketch(p))))


def estimate(cells: Column) -> Column:
    """Size of a difference from its sketch's numbers: with d digests, s of them net, the squares of a subtable's numbers
    add up to d (1 - 1/WIDTH) + s * s / WIDTH on average."""
    squares = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["n"] * c["n"]) / TABLES
    net = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["n"]) / TABLES
    return F.greatest(F.abs(net), (squares - net * net / WIDTH) / (1 - 1 / WIDTH))


def difference(marked: Column, base: Column, size: Column) -> Column:
    """Size of a symmetric difference: marked are both sets' ordered digests with side marks, base the difference of the
    two base sketches, size its estimate; all three columns. The base is peeled first, where it can hold so many;
    larger sketches follow until peeling ends."""

    def attempt(acc: Column, bits: Column) -> Column:
        return F.when(acc.isNotNull() | (F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 + bits) < size), acc).otherwise(_retry(marked, bits))

    first = F.when(size <= CELLS, peel(base))
    return F.aggregate(F.array(*[F.lit(b) for b in BITS]), first, attempt)


def likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """rows with `name`, the Jaccard similarity of digest sets a and b through their sketches s<a> and s<b>, 0 to 1.

    Each step is a projection of its own: higher-order functions evaluate what they hold again and again, columns not.
    """
    marked = F.array_sort(F.concat(a, F.transform(b, lambda d: d + 1)))
    rows = rows.withColumns({"_marked": marked, "_base": subtract(F.col(f"s{a}"), F.col(f"s{b}"))}).withColumn("_size", estimate(F.col("_base")))
    rows = rows.withColumn("_diff", difference(F.col("_marked"), F.col("_base"), F.col("_size")))
    both = F.size(a) + F.size(b)
    value = F.when(both == 0, F.lit(1.0)).otherwise((both - F.col("_diff")) / (both + F.col("_diff")))
    return rows.withColumn(name, value.cast("double")).drop("_marked", "_base", "_size", "_diff")


def written_out(cells: Column) -> Column:
    """A sketch as text: number, digest and check hash of each cell in hex."""
    return F.array_join(F.transform(cells, lambda c: F.when(c["key"] == 0, F.concat(c["n"].cast("string"), F.lit("."))).otherwise(F.concat_ws(".", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"])))), "-")


def with_next(docs: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """docs' rows with next_<c> for each carried column: the row after it in descending order of key (null last, ties by
    the first carried column); the last row's next is the first. No task orders more than about a range of rows."""
    spark = docs.sparkSession
    low = -(2**63)
    keyed = docs.withColumn("_id", F.coalesce(F.col(key).cast("long"), F.lit(low)))
    ids = keyed.select("_id")
    n, cuts = ids.agg(F.count("*"), F.percentile_approx("_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)).first()
    if not n:
        return keyed.select(*docs.columns, *[F.col(c).alias(f"next_{c}") for c in carried])
    cuts = sorted(set(cuts))
    per = max(1, n // (RANGE_ROWS * max(1, len(cuts) - 1)))
    edges = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def step(acc: Column, s: Column) -> Column:
        return F.when((acc + s <= len(cuts)) & (F.try_element_at(edges, acc + s) <= F.col("_id")), acc + s).otherwise(acc)

    at = F.greatest(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step), F.lit(1))
    lo, hi = F.element_at(edges, at).cast("double"), F.coalesce(F.try_element_at(edges, at + 1).cast("double"), F.element_at(edges, at).cast("double") + 1)
    sub = F.greatest(F.lit(0), F.least(F.lit(per - 1), F.floor((F.col("_id").cast("double") - lo) / F.greatest(F.lit(1.0), hi - lo) * per))).cast("int")
    ranged = lambda df: df.withColumn("_range", at).withColumn("_sub", sub)
    tops = ranged(ids).groupBy("_range", "_sub").agg(F.max("_id").alias("_id"))
    firsts = {r._range: r.s for r in tops.groupBy("_range").agg(F.min("_sub").alias("s")).collect()}  # QUANTILES + 1 rows at most
    order = sorted(firsts)
    above = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    hop = spark.createDataFrame([(r, above[r], firsts[above[r]]) for r in order], "_range int, _to int, _to_sub int")
    up = F.lead("_sub").over(Window.partitionBy("_range").orderBy("_sub"))
    tops = tops.withColumn("_up", up).join(F.broadcast(hop), "_range")
    tops = tops.select("_id", F.when(F.col("_up").isNull(), F.col("_to")).otherwise(F.col("_range")).alias("_range"), F.coalesce("_up", "_to_sub").alias("_sub"))
    few = n // RANGE_ROWS <= BROADCAST_TOPS
    ghosts = keyed.select("_id", *carried).join(F.broadcast(tops) if few else tops, "_id")
    real = ranged(keyed).withColumn("_ghost", F.lit(False))
    real = real.unionByName(ghosts.withColumn("_ghost", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("_range", "_sub").orderBy("_ghost", F.desc("_id"), *carried[:1])
    out = real.select(*[c for c in real.columns if c != "_id"], *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return out.filter(~F.col("_ghost")).drop("_range", "_sub", "_ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the contract's edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_paragraphs. One row per row; null text is empty; repeated rows are rows of their own; other
    columns are ignored; an empty table gives none.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base, "doc_id", ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(edited).alias("e"), digests(F.col("next_text")).alias("x"))
    rows = rows.select("*", *[sketch(F.col(c)).alias(f"s{c}") for c in "aex"])
    rows = likeness(likeness(rows, "a", "e", "near_edited"), "a", "x", "near_next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written_out(F.col("sa")).alias("fingerprint"), written_out(F.col("se")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("a").alias("n_paragraphs"),
    )


def op3_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: every whole text of `documents`."""
    return fingerprints(table(spark, sf_dir, "documents"))
