"""Document fingerprints by invertible Bloom lookup sketches, in SQL functions alone.

A text is cut into clauses (after a punctuation mark of any of several scripts, or a line
end; a clause of over ``LONG`` characters also after some of its words), and runs of
clauses between content-defined breaks are its paragraphs, of about four clauses at any
length of text.  A digest stands for a paragraph and a number of its repeats.

The digests are dealt by their bits to blocks of about ``BLOCK`` for the two versions
together.  In each block a digest goes to one cell in each third of the block's sketch; a
cell keeps a count, the XOR of its digests and the XOR of their checks.  Two sketches
subtract cell by cell, and peeling the cells that hold one digest recovers the digests in
which the versions differ.  If cells stay, both sides of the block are sketched again with
three times the cells; after the largest size the digests themselves are compared.  So
the work grows with the number of paragraphs, whatever the difference is.

A fingerprint is the sketch of one text by such blocks, each in the first size that can be
peeled down to nothing by itself (in none: the digests in place of cells).  So a stored
fingerprint gives all its digests back, and ``likeness_of`` two of them is what the
comparison of their texts gives.

The following document comes by two joins: narrow rows (id, hash of the text, length) are
sorted by range and know their neighbours; then each text meets the first half-length
characters and the digests of the next one.  Nothing is broadcast but what adaptive
execution measures as small, and the partitions follow the bytes.

Defined results: a null text is empty; two texts without paragraphs are alike by 1, one
with and one without by 0; rows of one id follow one another by a hash of their texts,
equal rows too; a null id sorts first; after the last row comes the first, so a single
row is its own neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, cut, tasks_for

#: Marks that end a clause.
SIGNS = ".,;:!?|\n。、，！？；：।۔؟،"
LONG = 96
#: One clause in ``EVERY`` ends a paragraph, in a long clause one word in ``WORDS``; powers of two.
EVERY, WORDS = 4, 16
BREAK = "\x01"
BLOCK = 8
SIZES = (18, 54, 162, 486)
ROUNDS = 16
PART_ROWS = 500_000
PART_CHARS = 16 << 20


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def paragraphs(text: str) -> str:
    """Hashes of a text's paragraphs, in order."""
    after = lambda part, every: f"if((xxhash64({part}) & {every - 1}) = 0, concat({part}, '{BREAK}'), {part})"
    words = f"array_join(transform(regexp_extract_all(p, '\\\\S{{1,16}}\\\\s*|\\\\s+', 0), w -> {after('w', WORDS)}), '')"
    clauses = f"transform(split({text}, '(?<=[{SIGNS}])'), p -> if(length(p) > {LONG}, {words}, {after('p', EVERY)}))"
    return f"transform(filter(split(array_join({clauses}, ''), '{BREAK}'), x -> x <> ''), x -> xxhash64(x))"


def digests(text: str) -> str:
    """Digests of each distinct paragraph: with the number of its repeats, and with all smaller powers of two.

    So versions that keep some of the repeats stay alike, and no two numbers of repeats are the same.
    """
    begins = "filter(transform(s, (x, i) -> if(i = 0 or s[i - 1] <> x, i, -1)), p -> p >= 0)"
    counts = "array_distinct(concat(transform(sequence(0, cast(floor(log2(c)) as int)), e -> shiftleft(1, e)), array(c)))"
    one = f"if(c = 1, array(xxhash64(s[p], 1)), transform({counts}, m -> xxhash64(s[p], m)))"
    runs = f"flatten(transform(b, (p, j) -> {let('c', 'coalesce(get(b, j + 1), size(s)) - p', one)}))"
    return let("s", f"sort_array({paragraphs(text)})", let("b", begins, runs))


def _check(key: str) -> str:
    return f"xxhash64({key}, 3)"


def _entry(key: str, third: int, sign: str = "1") -> str:
    """A digest with its check and cells."""
    cells = ", ".join(f"'{n}', cast({t * third} + pmod(xxhash64({key}, {t}), {third}) as int)" for t, n in enumerate("abc"))
    return f"named_struct('n', {sign}, 'k', {key}, 's', {_check(key)}, {cells})"


def _cells(entries: str, size: int) -> str:
    """The cells of entries; a cell of a third has to look at one place of each."""
    add = "named_struct('n', c.n + t.n, 'k', c.k ^ t.k, 's', c.s ^ t.s)"
    empty = "named_struct('n', 0, 'k', 0L, 's', 0L)"
    third = size // 3
    cells = (f"transform(sequence({j * third}, {(j + 1) * third - 1}), i -> aggregate(filter({entries}, t -> t.{x} = i), {empty}, (c, t) -> {add}))" for j, x in enumerate("abc"))
    return f"concat({', '.join(cells)})"


def sketch(keys: str, size: int) -> str:
    """The cells of a set of digests."""
    return let("es", f"transform({keys}, k -> {_entry('k', size // 3)})", _cells("es", size))


def subtract(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (l, r) -> named_struct('n', l.n - r.n, 'k', l.k ^ r.k, 's', l.s ^ r.s))"


def peel(cells: str, size: int) -> str:
    """The signed digests of a difference, or null if cells stay."""
    pure = f"filter(st.cells, c -> abs(c.n) = 1 and c.s = {_check('c.k')})"
    pure = f"array_distinct(transform({pure}, c -> {_entry('c.k', size // 3, 'c.n')}))"
    state = "named_struct('cells', {}, 'found', {}, 'idle', {})".format
    drop = "named_struct('n', c.n - t.n, 'k', c.k ^ t.k, 's', c.s ^ t.s)"
    cleared = f"transform(st.cells, (c, i) -> aggregate(filter(ps, t -> t.a = i or t.b = i or t.c = i), c, (c, t) -> {drop}))"
    found = "concat(st.found, transform(ps, t -> named_struct('n', t.n, 'k', t.k)))"
    step = f"if(st.idle, st, {let('ps', pure, state(cleared, found, 'size(ps) = 0'))})"
    start = state(cells, "cast(array() as array<struct<n:int,k:bigint>>)", "false")
    return (
        f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> {step}, "
        "st -> if(forall(st.cells, c -> c.n = 0 and c.k = 0 and c.s = 0), st.found, null))"
    )


def block_difference(left: str, right: str, sizes: tuple[int, ...]) -> str:
    """Signed digests (1: left alone, -1: right alone) of a block, retrying larger on failure."""
    tries = [peel(subtract(sketch(left, m), sketch(right, m)), m) for m in sizes]
    one = "transform(array_except({}, {}), k -> named_struct('n', {}, 'k', k))".format
    return f"coalesce({', '.join(tries)}, concat({one(left, right, 1)}, {one(right, left, -1)}))"


def _blocks(size: str) -> str:
    """The number of blocks for so many digests, a power of two."""
    return f"shiftleft(1L, cast(ceil(log2(greatest(1, ({size}) / {BLOCK}))) as int))"


def _by_block(rows: str) -> str:
    """Rows with a block b, sorted and cut into the runs of one block each: no block looks at the rows of others."""
    begins = "filter(transform(s, (x, i) -> if(i = 0 or s[i - 1].b <> x.b, i, -1)), p -> p >= 0)"
    return let("s", f"sort_array({rows})", let("g", begins, "transform(g, (p, j) -> slice(s, p + 1, coalesce(get(g, j + 1), size(s)) - p))"))


BLOCK_OF = "shiftrightunsigned(k, 20) & (n - 1)"


def difference(left: str, right: str, sizes: tuple[int, ...] = SIZES) -> str:
    """Signed digests in which two sets differ, block by block."""
    side = lambda keys, own: f"transform({keys}, k -> named_struct('b', {BLOCK_OF}, 'k', k, 'l', {own}))"
    of = lambda own: f"transform(filter(v, x -> {own}), x -> x.k)"
    body = let("l", of("x.l"), let("r", of("not x.l"), f"if(l = r, cast(array() as array<struct<n:int,k:bigint>>), {block_difference('l', 'r', sizes)})"))
    rows = f"concat({side(left, 'true')}, {side(right, 'false')})"
    return let("n", _blocks(f"size({left}) + size({right})"), f"flatten(transform({_by_block(rows)}, v -> {body}))")


def likeness(left: str, right: str, differing: str) -> str:
    """Shared digests over all, from the two counts and the recovered difference."""
    total = f"(size({left}) + size({right}))"
    return f"if({total} = 0, 1.0D, cast({total} - size({differing}) as double) / ({total} + size({differing})))"


def _peels(entries: str, size: int) -> str:
    """Whether the cells of entries can be peeled: in turn, those go that have a cell without another."""
    if size < 64:
        # an entry is its cells as bits; those of one entry and of more are told apart in one pass
        start = f"transform({entries}, t -> shiftleft(1L, t.a) | shiftleft(1L, t.b) | shiftleft(1L, t.c))"
        once = "aggregate(es, named_struct('o', 0L, 'm', 0L), (x, e) -> named_struct('o', x.o | e, 'm', x.m | (x.o & e)), x -> x.o & ~x.m)"
        step = let("u", once, "filter(es, e -> (e & u) = 0)")
    else:
        start = entries
        step = "filter(es, t -> not ({}))".format(" or ".join(f"size(filter(es, u -> u.{x} = t.{x})) = 1" for x in "abc"))
    return f"size(aggregate(sequence(1, {ROUNDS}), {start}, (es, r) -> if(size(es) = 0, es, {step}))) = 0"


def as_text(keys: str, sizes: tuple[int, ...] = SIZES) -> str:
    """The fingerprint of a set of digests: ``block:size cells``, a cell that is not empty by its place, count, digests and checks; empty blocks are left out."""
    shown = "transform({}, (c, j) -> if(c.n = 0, '', concat(j, '.', c.n, '.', hex(c.k), '.', hex(c.s))))".format
    plain = "concat('0 ', array_join(transform(v, x -> hex(x.k)), ' '))"
    for m in reversed(sizes):
        cells = f"concat('{m} ', array_join(array_remove({shown(_cells('ts', m))}, ''), ' '))"
        plain = let("ts", f"transform(v, x -> {_entry('x.k', m // 3)})", f"if({_peels('ts', m)}, {cells}, {plain})")
    rows = f"transform({keys}, k -> named_struct('b', {BLOCK_OF}, 'k', k))"
    return let("n", _blocks(f"size({keys})"), f"array_join(transform({_by_block(rows)}, v -> concat(v[0].b, ':', {plain})), '/')")


def digests_of(fingerprint: str, sizes: tuple[int, ...] = SIZES) -> str:
    """All digests of a fingerprint, peeled from its cells."""
    number = "cast(conv({}, 16, -10) as bigint)".format
    cell = let("q", "split(p, '[.]')", f"named_struct('j', cast(q[0] as int), 'n', cast(q[1] as int), 'k', {number('q[2]')}, 's', {number('q[3]')})")
    empty = "named_struct('n', 0, 'k', 0L, 's', 0L)"
    of_size = lambda m: let(
        "at", f"map_from_entries(transform(slice(ps, 2, size(ps)), p -> {let('c', cell, 'struct(c.j, c)')}))",
        peel(f"transform(sequence(0, {m - 1}), j -> if(at[j] is null, {empty}, named_struct('n', at[j].n, 'k', at[j].k, 's', at[j].s)))", m),
    )
    cases = " ".join(f"when ps[0] = '{m}' then transform({of_size(m)}, t -> t.k)" for m in sizes)
    listed = f"transform(slice(ps, 2, size(ps)), p -> {number('p')})"
    block = let("ps", "split(substring_index(b, ':', -1), ' ')", f"case when b = '' then cast(array() as array<bigint>) {cases} else {listed} end")
    return f"flatten(transform(split({fingerprint}, '/'), b -> {block}))"


def likeness_of(fingerprints: DataFrame, left: str, right: str) -> DataFrame:
    """``fingerprints`` with ``likeness`` of two columns of stored fingerprints, by subtracting and peeling."""
    out = fingerprints.withColumns({"_l": F.expr(digests_of(left)), "_r": F.expr(digests_of(right))})
    return out.withColumn("_d", F.expr(difference("_l", "_r"))).withColumn("likeness", F.expr(likeness("_l", "_r", "_d"))).drop("_l", "_r", "_d")


def neighbours(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(k, h, copies, n, pk, ph, half) of each distinct id and text: the row before it, and half that row's characters.

    ``docs`` has k, h and n.  The order is global, yet no task sees more than its range.
    """
    parts = tasks_for(docs, part_rows, docs.count())
    rows = docs.groupBy("k", "h").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    # written, so that a range keeps its number whatever is run again
    rows = cut(rows.repartitionByRange(parts, "k", "h").withColumn("part", F.spark_partition_id()), "ranges")
    last = rows.groupBy("part").agg(F.max(F.struct("k", "h", "n")).alias("last"))
    order = Window.orderBy("part")  # a row for each range
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = last.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("b"))
    own = Window.partitionBy("part").orderBy("k", "h")
    rows = rows.withColumn("a", F.lag(F.struct("k", "h", "n")).over(own)).join(before, "part").withColumn("a", F.coalesce("a", "b"))
    return cut(rows.select("k", "h", "copies", "n", F.col("a.k").alias("pk"), F.col("a.h").alias("ph"), F.expr("cast(a.n div 2 as int)").alias("half")), "neighbours")


def with_next(docs: DataFrame, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id``, ``text``, ``keys`` (its digests), and of the next row ``next_half`` (as many first characters as half the text has) and ``next_keys``."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    order = neighbours(docs.select("k", "h", F.char_length("text").alias("n")), part_rows)
    totals = order.agg(F.sum(F.col("n") * F.col("copies")).alias("chars"), F.max("copies").alias("copies")).first()
    parts = tasks_for(docs, part_chars, totals["chars"] or 0)
    keyed = docs.withColumn("keys", F.expr(digests("text"))).repartition(parts, "k", "h")
    if (totals["copies"] or 1) > 1:
        keyed = keyed.groupBy("k", "h").agg(F.first("text").alias("text"), F.first("keys").alias("keys"))
    rows = keyed.join(order, ["k", "h"])
    sent = rows.select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.expr("substring(text, 1, half)").alias("next_half"), F.col("keys").alias("next_keys"))
    out = rows.select("k", "h", "text", "keys", "copies").join(sent.repartition(parts, "k", "h"), ["k", "h"])
    # of equal rows all but one are followed by their own kind
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    own = F.expr("substring(text, 1, cast(char_length(text) div 2 as int))")
    return out.select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "text", "keys",
        F.when(F.col("copy") == 1, F.col("next_half")).otherwise(own).alias("next_half"), F.when(F.col("copy") == 1, F.col("next_keys")).otherwise(F.col("keys")).alias("next_keys"),
    )


def fingerprint_edits(docs: DataFrame, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """Fingerprints of each text and of its edit by the next text, with the differences and likenesses.

    The edit replaces the last half (rounded down) of the code points by as many of the next text's first.
    """
    out = with_next(docs, part_rows, part_chars).withColumn("n_chars", F.char_length("text").cast("long"))
    kept = "substring(text, 1, cast(n_chars - n_chars div 2 as int))"
    out = out.withColumn("edited", F.expr(f"concat({kept}, next_half)"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", "next_keys", F.expr(digests("edited")).alias("edited_keys"))
    out = out.select("*", F.expr(difference("keys", "edited_keys")).alias("edited_difference"), F.expr(difference("keys", "next_keys")).alias("next_difference"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(as_text("keys")).alias("fingerprint"), F.expr(as_text("edited_keys")).alias("edited_fingerprint"),
        F.expr(likeness("keys", "edited_keys", "edited_difference")).alias("near_edited"), F.expr(likeness("keys", "next_keys", "next_difference")).alias("near_next"),
        "edited_difference", "next_difference",
    )
