"""Operator 3: fuzzy line dedup with SimHash blocks and edit similarity.

Steps, all DataFrame and SQL functions:

1. Lines with a word are normalised (case, marks and white space go). Equal
   normalised lines are one line from here on, by two 64-bit hashes.
2. A line's features are its pairs of neighbouring words; lines of few words, also
   those in scripts without spaces, have runs of `GRAM` characters (`WIDE` where a
   character has three bytes), and lines in between have both. The 64-bit hashes of
   the features, sorted, form a ring.
3. The signature has `len(PLACES)` blocks. Block k is the SimHash of the `VOTES`
   features that follow place k on the ring: 64 bits, set where most of these have it. A
   changed word touches two features, so only the blocks that these vote in; the
   others agree in all bits (pigeonhole over the edited words, at any length of the
   line). Lines that agree in a block are candidates. They are linked where the
   edit similarity of their normalised lines is at least `SIMILARITY`.
4. In a bucket of more than two lines each is compared with the first. After the
   links have been grouped, lines of one bucket that are still in different groups
   are compared. So no pair that could join two groups is left out, and the pairs
   of a large group of near copies are not listed.
5. Of each group the first occurrence (by document id and line) stays.

A SimHash of the whole line cut into blocks of its own bits was given up: a line of
10 words with one replaced differs in some 9 of 64 bits, so blocks that still agree
are short, and short blocks meet by chance with the square of the lines.

Defined results: a null or empty text has no lines with a word and is unchanged
(null stays null); lines without a word always stay; lines that normalise to
nothing (marks only) count by their own text; documents without an id come after
the others; rows of equal id and text are documents of their own only by their
lines' order, so a repeated row loses the lines of the first; an empty table
gives an empty table; extra columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.columns import packed, settled, unpacked
from salesloom.llm.groups import connected
from salesloom.llm.sieve import marked, sifted
from salesloom.session import noted, remove, stored

PAIRS_FROM = 8  # words from which pairs of words are features
RUNS_BELOW = 12  # words below which runs of characters are features
GRAM, WIDE = 4, 2  # characters of a run; in scripts of three bytes a character
VOTES = 4  # features of a block
# Places spread evenly over the 64-bit numbers (multiples of the golden ratio), in order.
PLACES = tuple(sorted((k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(1, 13)))
SIMILARITY = 0.8
MARKS = r"[^\p{L}\p{N}]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
# Texts of some length are first compared in parts. By length from: characters of a part, of the anchor
# looked for at its end, of how far off that may be, and of a part that is cut without one.
PARTS = {2048: (32, 16, 1000, 2000), 256: (24, 8, 32, 192)}
ENDS = tuple(1 << k for k in range(13, -1, -1))  # characters by which common ends are found; their sum is the longest


def _normalised(rows: DataFrame) -> DataFrame:
    """Rows with `normal`: the line without case and marks; of a line of marks only, its text.

    In two steps, so that the words are found once per line.
    """
    rows = rows.withColumn("words", F.trim(F.regexp_replace(F.lower("line"), MARKS, " ")))
    return rows.withColumn("normal", F.when(F.col("words") == "", F.trim("line")).otherwise(F.col("words"))).drop("words")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every line: id, body (hash of the text, to tell repeated ids apart), place, line."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("body"), F.split(text, "\n").alias("lines"))
    return rows.select("id", "body", F.posexplode_outer("lines").alias("place", "line"))


def _keys() -> list[Column]:
    """Two 64-bit hashes that stand for a normalised line."""
    return [F.xxhash64("normal").alias("h1"), F.xxhash64(F.lit(1), "normal").alias("h2")]


def _occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every line with a word: id, body, place, h1, h2, normal."""
    lines = _normalised(_lines(docs, doc_id, text).where(F.col("line").rlike(HAS_WORD)))
    return settled(lines, "id", "body", "place", normal=F.col("normal")).select("id", "body", "place", *_keys(), "normal")


def _distinct(found: DataFrame, places: DataFrame) -> DataFrame:
    """Every normalised line once, signed and numbered: h1, h2, n, normal, size, blocks, line.

    Most lines occur once and are signed where they are read; only the text of those that may
    occur again is shuffled. `places` are the same occurrences, written without their text.
    """
    again = places.groupBy("h1").count().where("count > 1")
    asked = marked(found.select("h1", "h2", "normal"), again, "h1", "asked")
    rows = _signed(asked.select("h1", "h2", F.when(F.col("asked"), None).otherwise(1).cast("long").alias("n"), "normal"))
    rows = stored(rows.withColumn("line", F.monotonically_increasing_id()), "lines")
    often = rows.where("n is null").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("normal").alias("normal"))
    often = stored(_signed(often).withColumn("line", -1 - F.monotonically_increasing_id()), "lines-again")
    return rows.where("n is not null").unionByName(often)


def _signed(lines: DataFrame) -> DataFrame:
    """Lines (h1, h2, n, normal) with their blocks and length: h1, h2, n, normal, size, blocks; without blocks where n is null."""
    words = F.split("normal", " ")
    split = settled(lines, "h1", "h2", "n", "normal", words=words)
    pairs = F.transform("words", lambda w, k: F.xxhash64(w, F.get("words", k + 1)))
    long = F.when(F.octet_length("normal") >= 2.5 * F.length("normal"), WIDE).otherwise(GRAM)
    starts = F.sequence(F.lit(1), F.greatest(F.length("normal") - (F.col("long") - 1), F.lit(1)))
    runs = F.transform(starts, lambda k: F.xxhash64(F.lit(1), F.col("normal").substr(k, F.col("long"))))
    n = F.when(F.col("n").isNotNull(), F.size("words"))
    split = settled(split.withColumn("long", long), "h1", "h2", "n", "normal", pairs=F.when(n >= PAIRS_FROM, pairs), runs=F.when(n < RUNS_BELOW, runs))
    kept, both, none = ("h1", "h2", "n", "normal"), ("pairs", "runs"), F.array().cast("array<bigint>")
    split = settled(split, *kept, **{c: F.sort_array(F.array_distinct(c)) for c in both})
    among = {f"{c} and places": F.sort_array(F.concat(c, _places())) for c in both}
    split = settled(split, *kept, **{c: _around(c) for c in both}, **among)
    split = settled(split, *kept, **{c: F.when(F.col(c).isNotNull(), _blocks(c, f"{c} and places")).otherwise(none) for c in both})
    return settled(split, "h1", "h2", "n", "normal", size=F.length("normal"), blocks=F.array_distinct(F.concat("pairs", "runs")))


def _places() -> Column:
    return F.array(*[F.lit(c) for c in PLACES])


def _around(ring: str) -> Column:
    """The sorted `ring` and its first features again, so that each vote is one look-up; null for null."""
    few = F.when(F.size(ring) < VOTES, F.concat(*[ring] * VOTES)).otherwise(F.col(ring))
    return F.concat(ring, F.slice(few, 1, VOTES))


def _blocks(ring: str, among: str) -> Column:
    """For each place the SimHash of the next features of a `ring` that has been led `_around`.

    `among` holds the ring's features and places, sorted: a place's position there, less that among the places, is one in the ring.
    """
    firsts = F.transform(_places(), lambda c, k: F.array_position(among, c).cast("int") - k - 1)
    return F.transform(firsts, lambda p: _majority(*[F.get(ring, p + k) for k in range(VOTES)]))


def _majority(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The bits that more than half of four votes have."""
    return a.bitwiseAND(b).bitwiseAND(c.bitwiseOR(d)).bitwiseOR(c.bitwiseAND(d).bitwiseAND(a.bitwiseOR(b)))


def _candidates(lines: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) from the buckets, and the rows (key, line, size) of buckets with more than two lines."""
    keyed = lines.select(F.explode("blocks").alias("key"), "line", "size")
    # Rows of their own are smaller than partial sums, as nearly all buckets have one line; a bucket's sum takes no memory.
    sizes = keyed.repartition("key").groupBy("key").agg(
        F.count("*").alias("n"), F.min("line").alias("a"), F.max("line").alias("b"), F.min("size").alias("low"), F.max("size").alias("high")
    )
    sizes = stored(sizes.where((F.col("n") > 2) | ((F.col("n") == 2) & _as_long("low", "high", similarity))), "line-buckets")
    crowded = sizes.where("n > 2").select("key", F.col("a").alias("first"))
    crowds = stored(sifted(keyed, crowded, "key").join(crowded, "key"), "line-crowds")
    near = crowds.where("line != first").select(F.col("first").alias("a"), F.col("line").alias("b"))
    pairs = sizes.where("n = 2").select("a", "b").unionByName(near)
    return pairs.distinct(), crowds.select("key", "line", "size")


def _as_long(a: str, b: str, similarity: float) -> Column:
    """Whether two lengths allow the similarity."""
    most = F.floor((1 - similarity) * F.greatest(a, b) + 1e-9).cast("int")
    return F.abs(F.col(a) - F.col(b)) <= most


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose normalised lines are similar enough."""
    ends = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line")))
    texts = sifted(texts.select("line", "normal"), ends, "line")
    of = lambda name: texts.select(F.col("line").alias(name), F.col("normal").alias(f"text_{name}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    longest = F.greatest(F.length("text_a"), F.length("text_b"))
    most = F.floor((1 - similarity) * longest + 1e-9).cast("int")
    met = _stripped(met.where(F.abs(F.length("text_a") - F.length("text_b")) <= most).withColumn("most", most))
    # Near copies of some length are told by their parts; only the others need the whole table.
    x, y, near = F.col("text_a"), F.col("text_b"), F.lit(False)
    for least, sizes in sorted(PARTS.items()):
        near = F.when(F.least(F.length(x), F.length(y)) >= least, _in_parts(x, y, F.col("most"), *sizes) <= F.col("most")).otherwise(near)
    return met.where(near | F.expr("levenshtein(text_a, text_b, most) >= 0")).select("a", "b")


def _in_parts(x: Column, y: Column, most: Column, span: int, anchor: int, slip: int, long: int) -> Column:
    """A number of edits that turn x into y, part by part: at least their distance.

    Every `span` characters the next `anchor` characters of x are looked for in y, at most `slip` off from
    where the last cut lets them be, and where they are there once both texts are cut. The distances of
    the parts add up to an upper bound wherever the cuts lie. Counting ends above `most`.
    """
    starts = F.sequence(F.lit(1 + span), F.greatest(F.length(x) - anchor + 1, F.lit(1 + span)), F.lit(span))
    part = lambda a, b: F.when(a == b, 0).otherwise(F.levenshtein(a, b))

    def cut(so_far: Column, start: Column) -> Column:
        length, sought = start - so_far["x"], x.substr(start, F.lit(anchor))
        there = so_far["y"] + length
        low = F.greatest(there - slip, so_far["y"])
        anyway = F.when(length >= long, F.least(there, F.length(y) + 1))
        edits = lambda at: so_far["edits"] + part(x.substr(so_far["x"], length), y.substr(so_far["y"], at - so_far["y"]))
        moved = lambda at: F.when(at.isNull(), so_far).otherwise(F.struct(start.alias("x"), at.alias("y"), edits(at).alias("edits")))

        def place(window: Column) -> Column:
            again = lambda p: F.instr(window.substr(p + 1, F.length(window)), sought) > 0
            return _once(F.instr(window, sought), lambda p: F.when((p > 0) & ~again(p), low + p - 1).otherwise(anyway))

        found = _once(y.substr(low, there + slip + anchor - low), place)
        return F.when(so_far["edits"] > most, so_far).otherwise(_once(found, moved))

    rest = lambda t: F.when(t["edits"] > most, 0).otherwise(part(x.substr(t["x"], F.length(x)), y.substr(t["y"], F.length(y))))
    first = F.struct(F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("edits"))
    return F.aggregate(starts, first, cut, lambda t: t["edits"] + rest(t))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _stripped(met: DataFrame) -> DataFrame:
    """Pairs (a, b, most) with their texts without the beginning and end that they share, which leaves the distance as it is."""
    texts = ("text_a", "text_b")
    for _ in range(2):
        met = settled(met, "a", "b", "most", *texts, shared=_shared(*[F.col(c) for c in texts]))
        met = settled(met, "a", "b", "most", **{c: F.reverse(F.col(c).substr(F.col("shared") + 1, F.length(c))) for c in texts})
    return met


def _shared(x: Column, y: Column) -> Column:
    """How many characters two texts begin with in common, at most the sum of ENDS."""
    more = lambda n, k: x.substr(n + 1, k) == y.substr(n + 1, k)
    steps = F.array(*[F.lit(k) for k in ENDS])
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(more(n, k), F.least(n + k, F.length(x), F.length(y))).otherwise(n))


def line_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Every line with a word: id, body, place, h1, h2, group, kept."""
    with noted() as written:  # so that lines are normalised once; the text goes when they are signed, which write it again
        found = stored(_occurrences(docs, doc_id, text), "line-texts")
    places = stored(found.drop("normal"), "line-occurrences")
    lines = _distinct(found, places)
    remove(docs.sparkSession, written)
    pairs, crowds = _candidates(lines, similarity)
    pairs = stored(pairs, "line-pairs")
    links = stored(_linked(pairs, lines, similarity), "line-links")
    groups = connected(links, "line-groups")
    links = links.unionByName(_linked(_apart(crowds, groups, pairs, similarity), lines, similarity))
    groups = connected(links, "line-groups")
    named = lines.select("line", "h1", "h2", "n").join(groups, F.col("line") == F.col("node"), "left").where("n > 1 or component is not null")
    named = stored(named.select("h1", "h2", F.coalesce("component", "line").alias("group")), "line-names")
    return _decided(places, named)


def _apart(crowds: DataFrame, groups: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one bucket that no chain of links joins yet and that were not compared."""
    grouped = crowds.join(groups, crowds["line"] == groups["node"], "left").select("key", "line", "size", F.coalesce("component", "line").alias("group"))
    several = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("key")
    left = stored(grouped.join(several, "key", "left_semi"), "line-rest")
    right = left.select("key", F.col("line").alias("b"), F.col("group").alias("group_b"), F.col("size").alias("size_b"))
    met = left.withColumnRenamed("line", "a").join(right, "key").where(F.expr("a < b and group != group_b") & _as_long("size", "size_b", similarity))
    return stored(met.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), "line-pairs")


def _decided(found: DataFrame, named: DataFrame) -> DataFrame:
    """Each line's group (null for a line alone), and whether it is the group's first occurrence.

    Lines that no group can have stay where they are. The first occurrence is
    found per distinct line before lines of a group meet.
    """
    asked = marked(found, named, "h1", "asked")
    order = F.struct(F.col("id").isNull().alias("late"), "id", "place", "body")
    rows = stored(asked.where("asked").join(named, ["h1", "h2"], "left"), "line-rows")
    firsts = rows.where("group is not null").groupBy("h1", "h2", "group").agg(F.min(order).alias("first"))
    firsts = firsts.groupBy("group").agg(F.min("first").alias("first"))
    rows = rows.join(firsts, "group", "left")
    kept = F.col("group").isNull() | order.eqNullSafe(F.col("first"))
    rows = rows.select("id", "body", "place", "h1", "h2", "group", kept.alias("kept"))
    alone = asked.where("not asked").select("id", "body", "place", "h1", "h2", F.lit(None).cast("long").alias("group"), F.lit(True).alias("kept"))
    return rows.unionByName(alone)


def removed_lines(groups: DataFrame) -> DataFrame:
    """Per document the places of its lines that go: id, body, removed."""
    return groups.where("not kept").groupBy("id", "body").agg(F.sort_array(F.collect_set("place")).alias("removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, out: str = "n_removed_lines") -> DataFrame:
    """The documents without the lines that occur before; `out` counts what went."""
    removed = removed_lines(line_groups(docs, doc_id, text, similarity)).withColumn("spot", F.xxhash64("id", "body"))
    removed = stored(removed, "line-removed")
    rows = packed(docs, id=doc_id, body=F.xxhash64(text), text=text).withColumn("spot", F.xxhash64("id", "body"))
    # Only documents that may lose a line are shuffled to meet what they lose.
    rows = marked(rows, removed, "spot", "asked")
    met = rows.where("asked").select("row", "id", "body").join(removed, rows["id"].eqNullSafe(removed["id"]) & (rows["body"] == removed["body"]), "left")
    none = F.lit(None).cast("array<int>").alias("removed")
    met = met.select("row", "removed").unionByName(rows.where("not asked").select("row", none)).withColumn("text", F.col("row").getField(text))
    lines = F.split("text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    met = met.withColumn("lines", lines).withColumn("left", places)
    rest = F.array_join(F.transform("left", lambda k: F.get("lines", k)), "\n")
    whole = F.col("removed").isNull()
    gone = F.when(whole, 0).otherwise(F.size("removed")).cast("long")
    met = settled(met, "row", text=F.when(whole, F.col("text")).otherwise(rest), gone=gone)
    return unpacked(met, docs.columns, **{text: "text", out: "gone"})
