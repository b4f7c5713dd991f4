"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs, each hashed to a 64-bit digest: 48 bits of hash and 16 that check
them. Digests are dealt by their bits to as many sketches as their number asks for, about OWN to
each. A sketch has TABLES tables of cells; a digest goes to one cell of each, which holds the
number of its digests and their XOR. These cells, as a string, are the fingerprint.

Two fingerprints are compared by their cells alone. Sketches add and subtract cell by cell:
first the sum of all sketches of one fingerprint is subtracted from that of the other, so that what
the texts share is gone, and cells that hold a single digest are peeled, which gives back the
digests in which the texts differ. If that gets stuck, too many differ, and the sketches are
subtracted and peeled one by one; of texts of different size, the smaller one's digests are read
from its sketches first and dealt anew to as many as the larger one has. Should digests meet in
the same cell of every table even then, their number still follows from the cells. All of it is
DataFrame expressions within a row, whose work grows with the cells; a sketch is two plain arrays,
since a structure for each cell would cost more than what is done with it.

Paragraphs are lines. Lines above LINE code points are cut at sentence ends, else at white space,
else behind some of the letters, at least PIECE code points after the last cut: places that the text itself tells, so that an insertion changes the paragraphs around it and no others. Without
any such place within SEARCH code points, the cut is there. No size follows the text's length.

Defined results: null texts count as empty, empty lines as no paragraphs. A text without
paragraphs has an empty sketch; two of them are alike (1), such a text and another are not (0). The next document is the one with the next
larger id (null ids come first, and after the last comes the first); of rows that share an
id, the one whose text has the smallest hash stands for it. Repeated rows get equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import in_order, store, table, text_of

TABLES, WIDTH = 4, 6
CELLS = TABLES * WIDTH
#: Digests of one text in one sketch, on average at most; the difference of two texts has up to twice as many.
OWN = 4
#: Turns of peeling, at most, and how many of them are made at a time.
ROUNDS, TURNS = 16, 4
CHECK_BITS = 16
#: Code points: the longest line that stays whole, the least of a piece, and the most.
LINE, PIECE, SEARCH = 64, 32, 256
#: Some letters of every script, for lines without white space.
LETTERS = "aeiouAEIOU048" + "".join(f"\\x{{{c:X}}}-\\x{{{c + 31:X}}}" for c in range(0xA0, 0x10000, 256) if not 0xD800 <= c < 0xE000)
_UP_TO = f"[^\\r\\n]{{{PIECE - 1},{SEARCH - 1}}}?"
PARAGRAPH = "|".join(
    (
        f"[^\\r\\n]{{1,{LINE}}}+(?![^\\r\\n])",
        _UP_TO + "(?:[.!?;\u2026][\"')\\]\u00bb\u201d\u2019]*+[ \\t]++|[\u3002\uff01\uff1f\uff1b])",
        _UP_TO + "[ \\t]++",
        _UP_TO + f"[{LETTERS}]",
        f"[^\\r\\n]{{1,{SEARCH}}}",
    )
)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it, and not copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def _range(n: Column | int) -> Column:
    return F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1)


def _bits(key: Column, behind: Column | int) -> Column:
    """The hash in a digest without its last ``behind`` bits."""
    return F.call_function("shiftrightunsigned", key, F.lit(CHECK_BITS) + behind)


def _check(key: Column) -> Column:
    return F.xxhash64(_bits(key, 0)).bitwiseAND(F.lit((1 << CHECK_BITS) - 1))


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs."""
    high = F.lit(-1 << CHECK_BITS)
    digest = lambda p: _once(F.xxhash64(p).bitwiseAND(high), lambda k: k.bitwiseOR(_check(k)))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), digest))


def _places(key: Column) -> Column:
    """The cells of a digest, one in each table, as the bits of a number; the tables stand one after another."""

    def bit(h: Column, t: int) -> Column:
        at = F.pmod(F.shiftrightunsigned(h, 16 * t), F.lit(WIDTH)).cast("int")
        return F.call_function("shiftleft", F.lit(1 << t * WIDTH).cast("long"), at)

    def bits(h: Column) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [bit(h, t) for t in range(TABLES)])

    return _once(F.xxhash64(key, F.lit(CELLS)), bits)


def _sketch(n: Column, key: Column) -> Column:
    """The number of digests in every cell, and their XOR."""
    return F.struct(n.alias("n"), key.alias("key"))


def _placed(n: Column, key: Column) -> Column:
    """A signed digest with its cells."""
    return F.struct(n.alias("n"), key.alias("key"), _places(key).alias("at"))


def _if(condition: Column, one: Column | int, other: Column | int) -> Column:
    return F.call_function("if", condition, *[F.lit(x) if isinstance(x, int) else x for x in (one, other)])


def _cell_bits() -> Column:
    """The bit of each cell, as ``_places`` has them."""
    return F.array(*[F.lit(1 << i).cast("long") for i in range(CELLS)])


def _added(sketch: Column, items: Column, sign: int = 1) -> Column:
    """The sketch with signed digests ``(n, key, at)`` added, or taken out; cells that none goes to are left alone."""

    def each(values: Column, given: Column, add) -> Column:
        own = lambda v, bit: F.aggregate(given["items"], v, lambda a, d: _if(d["at"].bitwiseAND(bit) == 0, a, add(a, d)))
        return F.zip_with(values, _cell_bits(), lambda v, bit: _if(given["met"].bitwiseAND(bit) == 0, v, own(v, bit)))

    def changed(given: Column) -> Column:
        n = each(sketch["n"], given, lambda a, d: a + d["n"] if sign > 0 else a - d["n"])
        return _sketch(n, each(sketch["key"], given, lambda a, d: a.bitwiseXOR(d["key"])))

    met = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda m, d: m.bitwiseOR(d["at"]))
    return _once(items, lambda items: _once(F.struct(items.alias("items"), met(items).alias("met")), changed))


def _empty() -> Column:
    return _sketch(F.array_repeat(F.lit(0), CELLS), F.array_repeat(F.lit(0).cast("long"), CELLS))


def _merged(left: Column, right: Column, sign: int) -> Column:
    n = F.zip_with(left["n"], right["n"], lambda a, b: a + b if sign > 0 else a - b)
    return _sketch(n, F.zip_with(left["key"], right["key"], lambda a, b: a.bitwiseXOR(b)))


def subtract(left: Column, right: Column) -> Column:
    return _merged(left, right, -1)


def _dealt(keys: Column, bits: Column) -> Column:
    """Arrays of the digests, placed, by their last ``bits`` bits, in two steps, so that none reads all of them for each array."""

    def by(items: Column, ways: Column, field: str) -> Column:
        part = lambda items, w: F.filter(items, lambda d: d[field] == w)
        given = F.struct(items.alias("items"), ways.alias("ways"))
        return _once(given, lambda g: F.transform(_range(g["ways"]), lambda w: part(g["items"], w)))

    def split(s: Column) -> Column:
        def item(k: Column) -> Column:
            low = _bits(k, 0).bitwiseAND(s["low_ways"] - 1).cast("int")
            high = _bits(k, s["low"]).bitwiseAND(s["high_ways"] - 1).cast("int")
            return F.struct(F.lit(1).alias("n"), k.alias("key"), _places(k).alias("at"), high.alias("high"), low.alias("low"))

        parts = by(F.transform(keys, item), s["high_ways"], "high")
        return F.flatten(F.transform(parts, lambda part: by(part, s["low_ways"], "low")))

    ways = lambda n: F.call_function("shiftleft", F.lit(1), n)
    low = F.floor(bits / 2).cast("int")
    return _once(F.struct(low.alias("low"), ways(low).alias("low_ways"), ways(bits.cast("int") - low).alias("high_ways")), split)


def sketches(keys: Column, bits: Column) -> Column:
    """2 to the power of ``bits`` sketches of the digests."""
    return F.transform(_dealt(keys, bits), lambda own: _added(_empty(), own))


def fingerprint(keys: Column) -> Column:
    """The sketches of the distinct digests ``keys``, as many as their number asks for."""
    n = F.size(keys)
    bits = F.when(n <= OWN, 0).otherwise(F.ceil(F.log2(n / F.lit(float(OWN))))).cast("int")
    return sketches(keys, bits)


def held(prints: Column) -> Column:
    """Number of digests in a fingerprint."""
    own = lambda cells: F.aggregate(F.slice(cells["n"], 1, WIDTH), F.lit(0), lambda n, c: n + c)
    return F.aggregate(prints, F.lit(0), lambda n, cells: n + own(cells))


def peel(difference: Column) -> Column:
    """``found``: digests of one sketch or difference, n 1 on the left and -1 on the right; ``left``: how many stay in it, at least.

    Every turn takes out all digests that are alone in some cell.
    """

    low = F.lit((1 << CHECK_BITS) - 1)

    def alone(sketch: Column) -> Column:
        single = lambda n, k: (F.abs(n) == 1) & (_check(k) == k.bitwiseAND(low))

        def items(g: Column) -> Column:
            keys = F.filter(F.array_distinct(g["keys"]), lambda k: k.isNotNull())
            at = lambda k: F.array_position(g["keys"], k).cast("int") - 1
            placed = F.transform(keys, lambda k: _placed(g["n"][at(k)], k))
            return F.filter(placed, lambda d: d["at"].bitwiseAND(_cell_bits()[at(d["key"])]) != 0)

        keys = F.zip_with(sketch["n"], sketch["key"], lambda n, k: _if(single(n, k), k, F.lit(None).cast("long")))
        return _once(F.struct(sketch["n"].alias("n"), keys.alias("keys")), items)

    def step(state: Column, found: Column) -> Column:
        next_ = lambda cells, found, over: F.struct(cells.alias("cells"), found.alias("found"), F.lit(over).alias("over"))
        less = next_(_added(state["cells"], found, -1), F.concat(state["found"], found), False)
        over = _if(F.size(found) == 0, next_(state["cells"], state["found"], True), less)
        nothing = _sketch(F.array().cast("array<int>"), F.array().cast("array<bigint>"))
        return _if(all_of(state["cells"], found), next_(nothing, F.concat(state["found"], found), True), over)

    def all_of(cells: Column, found: Column) -> Column:
        """Whether these are the digests of a whole sketch: then they have the number and the XOR of all that is in one table."""
        total = lambda values, zero: F.aggregate(F.slice(values, 1, WIDTH), zero, lambda a, v: a + v)
        mixed = lambda values, zero: F.aggregate(F.slice(values, 1, WIDTH), zero, lambda a, v: a.bitwiseXOR(v))
        n = F.aggregate(found, total(cells["n"], F.lit(0)), lambda a, d: a - d["n"])
        key = F.aggregate(found, mixed(cells["key"], F.lit(0).cast("long")), lambda a, d: a.bitwiseXOR(d["key"]))
        return (n == 0) & (key == 0)

    def turn(state: Column, _: Column) -> Column:
        return _if(state["over"], state, _once(alone(state["cells"]), lambda found: step(state, found)))

    def turns(state: Column, _: Column) -> Column:
        # Some at a time, as every turn, even one that does nothing, copies the cells.
        return _if(state["over"], state, F.aggregate(_range(TURNS), state, turn))

    def least(n: Column, key: Column) -> Column:
        # A cell that is neither empty nor peeled holds two digests or more, an odd number three.
        some = _if(F.abs(n) == 1, 3, _if(n == 0, 2, F.abs(n)))
        return _if((n == 0) & (key == 0), 0, some)

    def left(cells: Column) -> Column:
        least_of = F.zip_with(cells["n"], cells["key"], least)
        by_table = lambda each: [F.aggregate(F.slice(each, t * WIDTH + 1, WIDTH), F.lit(0), lambda n, c: n + c) for t in range(TABLES)]
        empty = ~F.exists(cells["n"], lambda n: n != 0) & ~F.exists(cells["key"], lambda k: k != 0)
        return _if(empty, 0, _once(least_of, lambda each: F.greatest(*by_table(each))))

    none = F.array().cast("array<struct<n: int, key: bigint, at: bigint>>")
    start = F.struct(difference.alias("cells"), none.alias("found"), F.lit(False).alias("over"))
    end = F.aggregate(_range(ROUNDS // TURNS), start, turns)
    return _once(end, lambda s: F.struct(s["found"].alias("found"), left(s["cells"]).alias("left")))


def _together(peeled: Column) -> Column:
    """What was peeled from several sketches, as if from one."""
    joined = lambda parts: F.struct(
        F.flatten(F.transform(parts, lambda p: p["found"])).alias("found"),
        F.aggregate(parts, F.lit(0), lambda n, p: n + p["left"]).alias("left"),
    )
    return _once(peeled, joined)


def listed(prints: Column) -> Column:
    """The digests of a fingerprint, read from its cells, as ``peel`` gives them."""
    return _together(F.transform(prints, peel))


def differing(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """``df`` with ``name``: the digests that only one of two fingerprints has (``found``), and how many more (``left``).

    Takes no other columns than the two fingerprints into account; ``_small``, ``_own``, ``_anew`` and ``_parts`` are in use meanwhile.
    """
    l, r = F.col(left), F.col(right)
    whole = lambda prints: F.aggregate(prints, _empty(), lambda sums, cells: _merged(sums, cells, 1))
    ways = F.greatest(F.size(l), F.size(r))
    # Every digest that is peeled leaves a cell empty for good.
    too_many = (F.abs(held(l) - held(r)) > CELLS) & (ways > 1)
    stuck = F.col("_small").isNull() | ((F.col("_small.left") > 0) & (ways > 1))
    dealt_anew = stuck & (F.size(l) != F.size(r))
    smaller, larger = _if(F.size(l) < F.size(r), l, r), _if(F.size(l) < F.size(r), r, l)
    turned = lambda parts: F.transform(parts, lambda d: F.struct((-d["n"]).alias("n"), d["key"].alias("key"), d["at"].alias("at")))

    tried = df.withColumn("_small", F.when(~too_many, peel(subtract(whole(l), whole(r)))))
    read = tried.withColumn("_own", F.when(dealt_anew, listed(smaller)))
    keys = F.transform(F.col("_own.found"), lambda d: d["key"])
    less = F.zip_with(larger, _dealt(keys, F.round(F.log2(ways)).cast("int")), lambda cells, own: peel(_added(cells, own, -1)))
    placed = read.withColumn("_anew", F.when(dealt_anew, _together(less)))
    again = placed.withColumn("_parts", F.when(stuck & ~dealt_anew, _together(F.transform(F.zip_with(l, r, subtract), peel))))
    anew = F.struct(
        _if(F.size(l) < F.size(r), turned(F.col("_anew.found")), F.col("_anew.found")).alias("found"),
        (F.col("_anew.left") + F.col("_own.left")).alias("left"),
    )
    out = F.when(dealt_anew, anew).when(stuck, F.col("_parts")).otherwise(F.col("_small"))
    return again.withColumn(name, out).drop("_small", "_own", "_anew", "_parts")


def with_likeness(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """``df`` with ``name``: paragraphs shared, of all paragraphs (Jaccard), of two fingerprints."""
    both = held(F.col(left)) + held(F.col(right))
    apart = differing(df, left, right, "_apart").withColumn("_both", both)
    differ = F.least(F.size("_apart.found") + F.col("_apart.left"), F.col("_both"))
    counted = apart.withColumn("_differ", differ)
    shared = (F.col("_both") - F.col("_differ")) / (F.col("_both") + F.col("_differ"))
    return counted.withColumn(name, F.when(F.col("_both") == 0, F.lit(1.0)).otherwise(shared)).drop("_apart", "_both", "_differ")


def as_text(prints: Column) -> Column:
    """A fingerprint as a string: sketches apart by ``;``, cells by ``,``, an empty cell as nothing."""
    shown = lambda n, k: _if((n == 0) & (k == 0), F.lit(""), F.concat_ws(":", n, F.hex(k)))
    return F.array_join(F.transform(prints, lambda cells: F.array_join(F.zip_with(cells["n"], cells["key"], shown), ",")), ";")


def from_text(text: Column) -> Column:
    """The fingerprint that ``as_text`` wrote."""

    def sketch(cells: Column) -> Column:
        n = F.transform(cells, lambda c: F.when(c == "", 0).otherwise(F.split(c, ":")[0].cast("int")))
        key = F.transform(cells, lambda c: F.when(c == "", F.lit(0).cast("long")).otherwise(F.conv(F.split(c, ":")[1], 16, -10).cast("long")))
        return _sketch(n, key)

    return F.transform(F.split(text, ";"), lambda cells: _once(F.split(cells, ","), sketch))


def neighbours(df: DataFrame) -> DataFrame:
    """Per id: hash of the row that stands for it, the id before it, and the code points around."""
    own = store(
        df.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.xxhash64("text").alias("hash"), F.char_length("text").alias("n"))).alias("own"))
    )
    placed = in_order(own, "id")
    n = own.count()
    after = placed.select(((F.col("pos") + 1) % F.lit(max(n, 1))).alias("pos"), F.col("id").alias("prev_id"), F.col("own.n").alias("prev_n"))
    before = placed.select(F.pmod(F.col("pos") - 1, F.lit(max(n, 1))).alias("pos"), F.col("own.n").alias("next_n"))
    return store(placed.join(after, "pos").join(before, "pos").select("id", "rows", "own", "prev_id", "prev_n", "next_n"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, length, edited text, and the fingerprints of the text, of the edited and of the next document's text."""
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    around = neighbours(rows)
    # The texts are dealt by id once, as the joins want them, for both uses. The number is given, since
    # partitions that are small in bytes still have much to compute and are better left apart.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("digests", digests(F.col("text"))).repartition(parts, F.coalesce("id", F.lit(0).cast(rows.schema["id"].dataType)), F.isnull("id"))
    placed = rows.join(around, rows["id"].eqNullSafe(around["id"])).drop(around["id"])

    # Not as an equality, which would become a join key and deal the texts by id and hash.
    stands = F.xxhash64("text").bitwiseXOR(F.col("own.hash")) == 0
    head = placed.where(stands).select(
        F.col("prev_id").alias("head_id"),
        F.left("text", F.floor(F.col("prev_n") / 4).cast("int")).alias("head"),
        F.col("digests").alias("next_digests"),
    )
    if around.agg(F.max("rows")).first()[0] not in (None, 1):
        head = head.dropDuplicates(["head_id"])
    n = F.col("n")
    moved = F.floor(n / 4).cast("int")
    joined = rows.join(head, rows["id"].eqNullSafe(head["head_id"])).withColumn("n", F.char_length("text"))
    cut = joined.withColumn("edited", F.concat(F.left("text", n - moved), F.left("head", moved)))
    of = lambda keys: _once(keys, fingerprint)
    return cut.select(
        "id", "n", "edited",
        of(F.col("digests")).alias("prints"),
        of(digests(F.col("edited"))).alias("edited_prints"),
        of(F.col("next_digests")).alias("next_prints"),
    )


def compared(prints: DataFrame) -> DataFrame:
    prints = with_likeness(prints, "prints", "edited_prints", "near_edited")
    prints = with_likeness(prints, "prints", "next_prints", "near_next")
    return prints.select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("prints")).alias("fingerprint"),
        as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")))
