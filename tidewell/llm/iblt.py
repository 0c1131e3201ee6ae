"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame and SQL functions alone.

A text is cut to paragraphs at line ends and after ``.``, ``!`` or ``?`` and white space. A paragraph's digest is 40
bits of its hash with 24 check bits of those below, so the XOR of several digests almost never passes for one. A sketch
has 24 cells in three rows of 8; each digest goes, by XOR, to one cell of each row. Sketches of two versions subtract
by XOR: digests in both cancel out. A cell that passes its check holds one differing digest; taking that one out of its
other cells may lay bare further ones (peeling). If cells remain, the versions differ by more than a sketch can hold, and
a larger one is tried: 2^k sketches, each for the digests of its share (further bits tell which). Shares that still do
not peel are enlarged eightfold, twice at most; then the share's digests, which are at hand, are compared as sets. Paragraphs count once, however often they occur.

Null texts count as empty; an empty text has no paragraph and a sketch of zeros. Two texts without paragraphs are alike
by 1. Ids are ordered with nulls last; rows of one id by their text's hash. Equal rows stay rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a row, rounds of peeling, differing digests that a share of an enlarged sketch is meant for.
ROW, ROUNDS, SHARE = 8, 14, 10
#: Neighbouring ids that are looked at together, and equally filled ranges of ids that are told apart first.
NEAR, RANGES = 2000, 128
#: Parts by hash of the rows of an id that fills a range, or that is null.
SHARES = 256
CHECK = (1 << 24) - 1

#: Three bits of a digest choose its cell in each row: digest ``x`` belongs in cell ``i`` if ``x & MASK[i] = PLACE[i]``.
_MASK = [(ROW - 1) << (24 + 3 * (i // ROW)) for i in range(3 * ROW)]
_PLACE = [(i % ROW) << (24 + 3 * (i // ROW)) for i in range(3 * ROW)]
_longs = lambda x: f"array({', '.join(f'{v}L' for v in x)})"
_cell = lambda x, i: f"({x} & {_longs(_MASK)}[{i}]) = {_longs(_PLACE)}[{i}]"


def digests(text: str) -> Column:
    """The distinct paragraph digests of the text in column ``text``."""
    units = f"filter(split({text}, '[\\\\n\\\\r]+|(?<=[.!?])\\\\s+'), u -> u rlike '\\\\S')"
    parts = f"transform({units}, u -> shiftrightunsigned(xxhash64(u), 24))"
    return F.expr(f"array_distinct(transform({parts}, d -> shiftleft(d, 24) | (xxhash64(d) & {CHECK})))")


def _cells(keys: str) -> str:
    cell = "aggregate(filter({}, k -> (k & {}L) = {}L), 0L, (a, k) -> a ^ k)"
    return f"array({', '.join(cell.format(keys, m, p) for m, p in zip(_MASK, _PLACE))})"


def sketch(keys: str) -> Column:
    """The cells of the digests in column ``keys``."""
    return F.expr(_cells(keys))


def _dealt(keys: str, power: str) -> str:
    """The digests in ``2^power`` shares, dealt out in two steps."""
    coarse, fine = f"cast({power} / 2 as int)", f"({power} - cast({power} / 2 as int))"
    bits = lambda n: f"(cast(shiftleft(1, {n}) as int) - 1)"
    first = f"transform(sequence(0, {bits(coarse)}), g -> filter({keys}, q -> (shiftright(q, 36) & {bits(coarse)}) = g))"
    return f"flatten(transform({first}, y -> transform(sequence(0, {bits(fine)}), g -> filter(y, q -> (shiftright(q, 36 + {coarse}) & {bits(fine)}) = g))))"


def _peel(cells: str) -> str:
    """The digests in a difference of cells, or null if some cells remain."""
    pure = f"array_distinct(filter(s.c, (x, i) -> x <> 0 and {_cell('x', 'i')} and (xxhash64(shiftrightunsigned(x, 24)) & {CHECK}) = (x & {CHECK})))"
    after = f"zip_with(s.c, {_cells('p')}, (x, y) -> x ^ y)"
    step = f"if(s.go, transform(array({pure}), p -> if(size(p) > 0, named_struct('c', {after}, 'f', concat(s.f, p), 'go', true), named_struct('c', s.c, 'f', s.f, 'go', false)))[0], s)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('c', {cells}, 'f', cast(array() as array<bigint>), 'go', true), (s, r) -> {step}, s -> if(exists(s.c, x -> x <> 0), cast(null as array<bigint>), s.f))"


def _settled(a: str, b: str, left: int) -> str:
    """The digests in one of two shares but not in both; a share that does not peel is dealt out to eight, ``left`` times at most."""
    peeled = _peel(f"zip_with({_cells(a)}, {_cells(b)}, (p, q) -> p ^ q)")
    if not left:
        return f"coalesce({peeled}, concat(array_except({a}, {b}), array_except({b}, {a})))"
    eight = lambda x: f"transform(sequence(0, 7), g -> filter({x}, q -> (shiftrightunsigned(q, {54 + 3 * left}) & 7) = g))"
    x, y = f"x{left}", f"y{left}"
    return f"coalesce({peeled}, flatten(zip_with({eight(a)}, {eight(b)}, ({x}, {y}) -> {_settled(x, y, left - 1)})))"


def differing(a: str, b: str, cells_a: str, cells_b: str) -> Column:
    """The digests in one of two columns of digests but not in both, from their sketches; larger ones where these fail."""
    power = f"cast(ceil(log2(greatest(1, (size({a}) + size({b})) / {SHARE}))) as int)"
    base = _peel(f"zip_with({cells_a}, {cells_b}, (p, q) -> p ^ q)")
    larger = f"flatten(zip_with({_dealt(a, power)}, {_dealt(b, power)}, (x, y) -> {_settled('x', 'y', 2)}))"
    return F.expr(f"coalesce({base}, {larger})")


def likeness(a: str, b: str, cells_a: str, cells_b: str) -> Column:
    """Paragraphs in common over paragraphs in all, from the number of differing digests."""
    both = F.size(a) + F.size(b)
    found = F.transform(F.array(F.size(differing(a, b, cells_a, cells_b))), lambda d: (both - d) / (both + d))  # bound once
    return F.when(both == 0, F.lit(1.0)).otherwise(found[0]).cast("double")


def as_text(cells: str) -> Column:
    return F.expr(f"lower(array_join(transform({cells}, c -> lpad(hex(c), 16, '0')), ''))")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, keys, cells`` and the same of the next document in descending id, ``next_text, next_keys, next_cells``.

    Ids fall into ranges of about ``NEAR`` rows; a window looks at the next row within a range, and each range also gets
    the first row of the next one. Only the ranges' first ids, one row for each range, are ever ordered as a whole. Ranges
    are cut at quantiles twice, so ids far from the others do not crowd one; null ids, and an id that fills a range by
    itself, are cut by the hash of the text, in whose order rows of one id come.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = [k / RANGES for k in range(RANGES + 1)]
    seen = rows.agg(F.count("*"), F.percentile_approx("doc_id", cuts, 10_000)).first()
    edges = F.array(*[F.lit(e).cast("long") for e in sorted({*(seen[1] or [0])})])
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    upto = lambda ends: F.greatest(F.lit(1), F.size(F.filter(ends, lambda e: e <= key)))
    coarse = F.when(F.col("doc_id").isNull(), 0).otherwise(upto(edges)).alias("coarse")
    # a row for each of at most RANGES + 2 coarse ranges, with as many ends of its own
    fine = F.coalesce(F.percentile_approx("doc_id", cuts, 10_000), F.array().cast("array<bigint>"))
    inner = F.broadcast(rows.select("doc_id", coarse).groupBy("coarse").agg(fine.alias("fine"), F.count("*").alias("n")))
    marked = rows.withColumns({"mark": F.xxhash64("text"), "coarse": coarse}).join(inner, "coarse")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / (NEAR * RANGES)))  # of a fine range
    of = F.when(F.size("fine") > 0, upto(F.col("fine"))).otherwise(1)
    low, high = F.coalesce(F.get("fine", of - 1), F.lit(0)), F.coalesce(F.get("fine", F.least(of, F.size("fine") - 1)), F.lit(0))
    along = F.floor((key.cast("double") - low) * parts / F.greatest(high.cast("double") - low, F.lit(1.0)))
    part = F.least(parts - 1, F.greatest(F.lit(0).cast("long"), along))
    alone = F.col("doc_id").isNull() | (F.size(F.filter("fine", lambda e: e == key)) > 1)
    share = F.floor((F.col("mark") / 2 + float(1 << 62)) / float(1 << 63) * SHARES)  # rows of one id come in order of the mark
    place = F.when(alone, SHARES - 1 - F.least(F.lit(SHARES - 1), F.greatest(F.lit(0).cast("long"), share))).otherwise(SHARES + part)
    number = (F.col("coarse").cast("long") * (RANGES + 2) + of) * (1 << 32) + place
    placed = marked.withColumn("range", number).select("doc_id", "text", "range", "mark")
    heads = placed.groupBy("range").agg(F.max(F.struct(key.alias("k"), F.bitwise_not("mark").alias("m"), "mark")).alias("h"))
    order = Window.orderBy(F.desc("range"))
    first = F.first("h.k").over(order), F.first("h.mark").over(order), F.first("range").over(order)
    after = heads.select(F.col("range").alias("to"), F.coalesce(F.lead("range").over(order), first[2]).alias("range"), F.coalesce(F.lead("h.k").over(order), first[0]).alias("k"), F.coalesce(F.lead("h.mark").over(order), first[1]).alias("mark"))
    ghosts = placed.withColumn("k", key).join(after, ["range", "k", "mark"]).select("doc_id", "text", F.col("to").alias("range"), "mark", F.lit(1).alias("ghost"))
    # digests and cells are made behind the shuffle, which carries texts alone
    every = placed.select("doc_id", "text", "range", "mark", F.lit(0).alias("ghost")).union(ghosts).repartition("range").withColumn("keys", digests("text")).withColumn("cells", sketch("keys"))
    near = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), "mark")
    out = every.withColumns({"next_text": F.lead("text").over(near), "next_keys": F.lead("keys").over(near), "next_cells": F.lead("cells").over(near)})
    return out.where("ghost = 0").select("doc_id", "text", "keys", "cells", "next_text", "next_keys", "next_cells")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of every whole text and of its edited text: sketches as text, and how like the sketch is to the edited and to the next text's."""
    n = F.length("text")
    half = (n / 2).cast("int")
    rows = with_next(docs).withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))})
    rows = rows.withColumns({"edited_keys": digests("edited"), "edited_sha256": F.sha2("edited", 256)}).drop("text", "next_text", "edited")
    rows = rows.withColumn("edited_cells", sketch("edited_keys"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text("cells").alias("fingerprint"), as_text("edited_cells").alias("edited_fingerprint"), likeness("keys", "edited_keys", "cells", "edited_cells").alias("near_edited"), likeness("keys", "next_keys", "cells", "next_cells").alias("near_next"))
