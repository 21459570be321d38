"""Near-equal lines by a segment-partition edit join, in DataFrame operations only.

Two lines within ``EDITS`` edits share one of ``EDITS + 1`` segments of the shorter one, at a position
that the length difference and the segment's number allow. Lines are indexed by (length, segment
number, segment) and probe with their substrings for every length within reach. Where very many
lines share a segment, the rest of those lines is cut into segments in turn, until few share them
all. Candidates whose letters differ in number are dropped at once; the others are verified with a bit-parallel edit distance over a band of diagonals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.llm.graph import components
from grantlens.llm.tables import bucketed, cut_lineage

EDITS = 2
CHARS_PER_EDIT = 10  # a line may differ by one edit for so many characters
HOT = 64  # lines that may share a segment before the rest of the line is looked at
DEPTH = 3  # so often at most
COUNTED = "eant"  # letters whose numbers are compared before anything else
COMPARED = "eantiorshdlucmg "  # letters whose numbers are compared once two lines have met


def allowed_edits(length: Column, edits: int = EDITS) -> Column:
    return F.least(F.lit(edits), F.floor(length / CHARS_PER_EDIT)).cast("int")


def _cut(length: Column, i: int, parts: int) -> Column:
    """Where segment ``i`` (from 0) of a line of ``length`` characters begins, counted from 0."""
    return F.floor(length * i / parts).cast("int")


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(characters less, segment, shift) of all substrings to look up, the line's own segments first.

    A substring may equal segment ``i`` of a line that is ``less`` characters shorter or as long. At
    most ``edits`` edits lie to either side of a segment that matches, and one in each segment before
    the first that does: that bounds the shift. Among lines as long, up to three edits move all that is
    moved to one side, seen from one line, and to the other side, seen from the other: one looks.
    """
    out = [(0, i, 0) for i in range(edits + 1)]
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            if not less and edits <= 3:
                low = 1
            out += [(less, i, shift) for shift in range(low, high + 1) if less or shift]
    return out


def _measured(level: DataFrame, edits: int) -> DataFrame:
    """(id, rest, prefix, counts) with its length and the cuts of all lengths in reach, worked out once."""
    level = level.select("id", "rest", "prefix", "counts", F.length("rest").alias("n"))
    cuts = [
        F.expr(f"(n - {less}) * {i} div {edits + 1}").cast("int").alias(f"c{less}_{i}")
        for less in range(edits + 1)
        for i in range(edits + 2)
    ]
    return level.select("*", *cuts)


def _place(place: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    """Start and size of a substring of a measured line, and its key (null where it does not fit)."""
    less, i, shift = place
    at = F.col(f"c{less}_{i}") + shift
    size = F.col(f"c{less}_{i + 1}") - F.col(f"c{less}_{i}")
    key = F.xxhash64("prefix", F.col("n") - less, F.lit(i), F.substring(F.col("rest"), at + 1, size))
    return at, size, F.when((at >= 0) & (at + size <= F.col("n")) & (F.col("n") >= less), key)


def letter_counts(text: Column) -> Column:
    """How often each of the ``COUNTED`` letters occurs (255 at most), a byte for each."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(COUNTED):
        count = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(F.least(count, F.lit(255)).cast("long"), 8 * k))
    return out


def letters_apart(x: Column, y: Column) -> Column:
    """By how many letters two counts differ: at most two for each edit between the texts."""
    byte = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255).cast("long"))
    return sum((F.abs(byte(x, k) - byte(y, k)) for k in range(len(COUNTED))), F.lit(0))


def letters_near(x: Column, y: Column, edits: int) -> Column:
    """Whether the numbers of the ``COMPARED`` letters allow two texts to be within ``edits``."""
    left = lambda c, letter: F.octet_length(F.replace(c, F.lit(letter), F.lit("")))
    more = F.octet_length(x) - F.octet_length(y)
    apart = [F.abs(more - left(x, letter) + left(y, letter)) for letter in COMPARED]
    return sum(apart, F.lit(0)) <= 2 * edits


def _keys(level: DataFrame, edits: int, places: list[tuple[int, int, int]]) -> DataFrame:
    """(key, id, counts) for every one of ``places`` of every line."""
    keys = F.array(*[_place(p)[2] for p in places])
    rows = _measured(level, edits).select(F.explode(keys).alias("key"), "id", "counts")
    return rows.where("key is not null")


def _rests(level: DataFrame, edits: int) -> DataFrame:
    """(id, key, rest): every line without a substring, for each of them."""
    entries = []
    for p in _places(edits):
        at, size, key = _place(p)
        rest = F.concat(F.substring(F.col("rest"), F.lit(1), at), F.substring(F.col("rest"), at + size + 1, F.col("n")))
        entries.append(F.when(key.isNotNull(), F.struct(key.alias("key"), rest.alias("rest"))))
    rows = _measured(level, edits).select("id", F.explode(F.array(*entries)).alias("e"))
    return rows.where("e is not null").select("id", "e.*")


def _candidates(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of ids that share segments; every pair within reach is among them.

    ``lines`` has (id, rest, counts), each id once and of 63 bits. A segment that more than ``HOT`` lines have
    stands in the index as one entry without an id; the lines that meet it go on to the next level with
    what is left of them.
    """
    level = lines.select("id", "rest", F.lit(0).cast("long").alias("prefix"), "counts")
    places = _places(edits)
    found = []
    for depth in range(DEPTH + 1):
        index = _keys(level, edits, places[: edits + 1])
        counts = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        hot = cut_lineage(counts.where(F.col("n") > HOT).select("key", "n"))
        nothing = F.lit(None).cast("long")
        index = index.join(hot.select("key"), "key", "left_anti").union(hot.select("key", nothing, nothing))
        # dealt out by key at any size: the index grows with the input
        met = _keys(level, edits, places).join(index.toDF("key", "other", "theirs").hint("merge"), "key")
        alike = letters_apart(F.col("counts"), F.col("theirs")) <= 2 * edits
        met = met.where(F.col("other").isNull() | ((F.col("other") != F.col("id")) & alike))
        met = cut_lineage(
            met.select(
                F.when(F.col("other").isNull(), F.col("key")).alias("key"),
                F.least("id", F.coalesce("other", "id")).alias("a"),
                F.when(F.col("other").isNotNull(), F.greatest("id", "other")).alias("b"),
            ).distinct()
        )
        found.append(met.where("b is not null").select("a", "b"))
        many = met.where("b is null").select("key", F.col("a").alias("id"))
        if many.isEmpty():
            break
        rests = _rests(level.join(many.select("id").distinct(), "id", "left_semi"), edits)
        rests = rests.join(many, ["key", "id"], "left_semi").select(
            "id", "rest", F.col("key").alias("prefix")
        )
        level = cut_lineage(rests.distinct().withColumn("counts", letter_counts(F.col("rest"))))
        if depth == DEPTH:
            found.append(_crowded(level, edits))
    out = found[0]
    for pairs in found[1:]:
        out = out.union(pairs)
    return out.distinct()


def _crowded(level: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) among lines that still share a segment with many: each line meets blocks of lines.

    ``level`` has (id, rest, prefix, counts). A block is an array of about ``HOT`` lines; only the lines of it
    that may be close to a line leave it, so the pairs that are not are never rows.
    """
    sizes = level.groupBy("prefix").agg(F.ceil(F.count(F.lit(1)) / HOT).alias("_blocks"))
    line = F.struct("id", "rest", "counts")
    blocks = level.join(sizes, "prefix").groupBy("prefix", F.pmod(F.xxhash64("id"), F.col("_blocks")).alias("_block"))
    blocks = blocks.agg(F.collect_list(line).alias("_lines")).select("prefix", "_lines")

    def close(x: Column) -> Column:
        mine, other = F.col("rest"), x["rest"]
        longer = F.when(F.length(mine) >= F.length(other), mine).otherwise(other)
        shorter = F.when(F.length(mine) >= F.length(other), other).otherwise(mine)
        near = F.length(longer) - F.length(shorter) <= edits
        alike = letters_apart(F.col("counts"), x["counts"]) <= 2 * edits
        return (x["id"] > F.col("id")) & alike & near & may_be_close(longer, shorter, edits)

    near = level.join(blocks, "prefix").select("id", F.explode(F.filter("_lines", close)).alias("_x"))
    return near.select(F.col("id").alias("a"), F.col("_x.id").alias("b")).distinct()


def banded_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of ``a`` and ``b``, not longer, if it is at most ``edits``; else more.

    A column of the distance table is one word of vertical differences, of which only the band of
    2 * edits + 1 diagonals around the main one is kept: each character of ``b`` moves the word one
    row down. The distance is followed along the band's lower edge to the last row of the table, then
    along that row.
    """
    bits = 2 * edits + 2
    mask, top = (1 << bits) - 1, 1 << (bits - 1)
    number = lambda x: F.lit(x).cast("long")
    n_a, n_b = F.length(a), F.length(b)
    pad = F.array_repeat(F.lit(""), bits)

    def advance(acc: Column, char: Column) -> Column:
        s, n = acc["s"], acc["n"]
        m = number(0)
        for bit in range(bits):
            row = s["j"] + edits - (bits - 1) + bit  # counted from 1
            same = F.get(acc["p"], row - 1 + bits) == char
            m = m + F.when(same, number(1 << bit)).otherwise(number(0))
        sums = lambda x: (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])
        d0 = _bound(m, lambda x: sums(x).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(number(mask)))
        return F.struct(
            _bound(d0, lambda d: moved(s, n, d)).alias("s"), acc["p"].alias("p"), n.alias("n")
        )

    def moved(s: Column, n: Column, d0: Column) -> Column:
        hp = s["vn"].bitwiseOR(number(mask) - d0.bitwiseOR(s["vp"]))
        hn = d0.bitwiseAND(s["vp"])
        below = s["j"] + edits - n  # rows of the band that the table does not have
        bit = F.call_function("shiftright", number(top), F.greatest(below, F.lit(0)))
        edge = F.when(d0.bitwiseAND(number(top)) == 0, 1).otherwise(0)
        along = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(
            hn.bitwiseAND(bit) != 0, 1
        ).otherwise(0)
        down = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(number(mask) - down.bitwiseOR(hp)).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (s["d"] + F.when(below <= 0, edge).otherwise(along)).alias("d"),
            (s["j"] + 1).alias("j"),
        )

    first = F.struct(
        number(mask - ((1 << (bits - edits - 1)) - 1)).alias("vp"),
        number(0).alias("vn"),
        F.least(n_a, F.lit(edits)).alias("d"),
        F.lit(1).alias("j"),
    )
    start = F.struct(
        first.alias("s"),
        F.concat(pad, F.split(a, ""), pad).alias("p"),  # worked out once and handed on
        n_a.alias("n"),
    )
    followed = F.aggregate(F.split(b, ""), start, advance, lambda acc: acc["s"]["d"])
    return F.when(n_a - n_b > edits, F.lit(edits + 1)).when(n_b == 0, n_a).otherwise(followed)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of characters that two columns begin with alike, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(16, -1, -1)])
    most = F.least(F.length(a), F.length(b))

    def longer(p: Column, step: Column) -> Column:
        same = F.substring(a, p + 1, step) == F.substring(b, p + 1, step)
        return F.when((p + step <= most) & same, p + step).otherwise(p)

    return F.aggregate(steps, F.lit(0), longer)


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is looked at."""
    return F.element_at(F.transform(F.array(value), then), 1)


def without_common_ends(longer: Column, shorter: Column, then) -> Column:
    """``then(longer, shorter)`` of what differs, turned round twice: the distance stays the same."""

    def cut(pair: Column, after) -> Column:
        x, y = pair["x"], pair["y"]
        rest = lambda c, p: F.reverse(F.substring(c, p + 1, F.length(c)))
        return _bound(
            common_prefix(x, y),
            lambda p: _bound(F.struct(rest(x, p).alias("x"), rest(y, p).alias("y")), after),
        )

    pair = F.struct(longer.alias("x"), shorter.alias("y"))
    return _bound(pair, lambda s: cut(s, lambda t: cut(t, lambda u: then(u["x"], u["y"]))))


def may_be_close(longer: Column, shorter: Column, edits: int = EDITS, parts: int = 8) -> Column:
    """Whether enough segments of the shorter line are found in the longer one, near their places.

    An edit spoils one segment at most, so of ``parts`` at least ``parts - edits`` stay, moved by at
    most ``edits``: a necessary condition, worked out without looking at single characters.
    """
    n, kept = F.length(shorter), F.lit(0)
    for i in range(parts):
        begin = _cut(n, i, parts)
        size = _cut(n, i + 1, parts) - begin
        around = F.substring(
            longer, F.greatest(begin + 1 - edits, F.lit(1)), size + edits + F.least(begin, F.lit(edits))
        )
        kept = kept + F.when(F.contains(around, F.substring(shorter, begin + 1, size)), 1).otherwise(0)
    return kept >= parts - edits


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line_id, line) of every line that is not blank; lines count from 0."""
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.where(F.length(F.trim("line")) > 0)
    return rows.select("doc_id", "line_no", F.shiftrightunsigned(F.xxhash64("line"), 1).alias("line_id"), "line")


def line_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b) ids of different lines within ``allowed_edits`` of the shorter one's length."""
    # in buckets, as what is found about lines comes back to their texts several times
    lines = lines.groupBy(F.col("line_id").alias("id")).agg(F.any_value("line").alias("rest"))
    lines = bucketed(lines.withColumn("counts", letter_counts(F.col("rest"))), "id")
    pairs = None
    for e in range(edits, 0, -1):
        # lines that may differ by e edits; by fewer if one is shorter, which comes with its own turn
        least = e * CHARS_PER_EDIT
        own = lines.where(F.length("rest") >= least)
        if e < edits:
            own = own.where(F.length("rest") < least + CHARS_PER_EDIT + e)
        found = _candidates(own, e)
        pairs = found if pairs is None else pairs.union(found)
    pairs = cut_lineage(pairs.distinct())
    texts = lines.select("id", "rest")
    both = pairs.join(texts.toDF("a", "_x"), "a").join(texts.toDF("b", "_y"), "b")
    swap = F.length("_x") < F.length("_y")
    both = both.select(
        "a",
        "b",
        F.when(swap, F.col("_y")).otherwise(F.col("_x")).alias("longer"),
        F.when(swap, F.col("_x")).otherwise(F.col("_y")).alias("shorter"),
    )
    both = both.where(may_be_close(F.col("longer"), F.col("shorter"), edits))
    both = cut_lineage(both.where(letters_near(F.col("longer"), F.col("shorter"), edits)))
    allowed = allowed_edits(F.length("shorter"), edits)

    def close(x: Column, y: Column) -> Column:
        # both ends differ now, so that segments rule out nearly all that are too far apart
        return may_be_close(x, y, edits) & (banded_distance(x, y, edits) <= allowed)

    both = both.where(without_common_ends(F.col("longer"), F.col("shorter"), close))
    return cut_lineage(both.select("a", "b"))


def dedup_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """One row per line that is not blank: ``doc_id``, ``line_no``, ``line_id``, ``n_links``, ``class_id``, ``kept``.

    Lines are linked if they differ by at most ``edits`` edits and one for every ``CHARS_PER_EDIT``
    characters of the shorter one; ``n_links`` counts the other texts linked directly. A class is what
    links connect, named by its smallest line_id (a 63-bit hash of the text, by which texts are told
    apart). The first line of a class by doc_id and line_no is ``kept``, null ids first; rows that repeat
    id and text count once each, and of lines that agree in all that every copy is kept. Null, empty
    and blank texts have no lines. Lines are parted by U+000A.
    """
    lines = line_table(docs)
    links = line_links(lines, edits)
    parts = components(links)
    both = links.select(F.col("a").alias("line_id")).union(links.select("b"))
    counts = both.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_links"))
    linked = counts.join(parts.withColumnRenamed("node", "line_id"), "line_id")
    rows = lines.select("doc_id", "line_no", "line_id").join(linked, "line_id", "left")
    rows = rows.select(
        "doc_id",
        "line_no",
        "line_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "line_id").alias("class_id"),
    )
    place = F.struct("doc_id", "line_no")
    first = rows.groupBy("class_id").agg(F.min(place).alias("_first"))
    return rows.join(first, "class_id").select(
        "doc_id", "line_no", "line_id", "n_links", "class_id", (place == F.col("_first")).alias("kept")
    )


def remove_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the lines that :func:`dedup_lines` does not keep. Blank lines stay."""
    gone = found.where("not kept").groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set("line_no").alias("_gone")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, "doc_id").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    whole = F.col("_row")["text"]
    stays = F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(stays, "\n"))
    return rows.select(
        *[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    )
