"""Operator 4: benchmark decontamination as a prefix-filtered set join.

An item gives windows of 13 words (a shorter item one window of all its words).
A window is a set of words at fixed places that a document must contain whole,
so the prefix that any match has to share is one word: the window's rarest. The
documents' words are joined with these prefix words only; a hit proposes one
place for the window, the bounds of length and position discard places outside
the document, and the words there are compared exactly.

Rarity is counted over all documents. The prefix table's size follows the
benchmark; it is broadcast only below `BROADCAST_ROWS` windows, above that the
words meet it in a shuffle join of narrow rows (word, document, place) and
the texts are joined once more for the comparison.

Defined results: a null or empty text has no words and is clean; items without
words have no windows; items of equal text all count; documents are reported row
by row, repeated rows included; an empty benchmark leaves every document clean;
extra columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.columns import ascii_lower, packed, unpacked
from salesloom.llm.sieve import marked
from salesloom.session import stored

WINDOW = 13
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what separates words, before lower-casing
BROADCAST_ROWS = 200_000  # windows of 13 words: some tens of MB


def benchmark_words(text: Column) -> Column:
    """Words of digits, letters and all characters beyond ASCII, in the spelling of the text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), APART), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The windows of (item_id, text): item, found (its lower-cased words)."""
    found = F.transform(benchmark_words(F.col("text")), lambda w: ascii_lower(w))
    rows = items.select(F.col("item_id").alias("item"), found.alias("found")).where(F.size("found") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("found") - size + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.slice("found", i, F.lit(size)))
    return rows.select("item", F.explode(windows).alias("found"))


def prefixes(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Distinct windows with their rarest word: token, offset, found, items.

    The token is folded by `lower`, a coarser spelling that any match shares.
    """
    windows = windows.groupBy("found").agg(F.sort_array(F.collect_set("item")).alias("items"))
    words = windows.select("found", F.posexplode("found").alias("offset", "word"))
    words = words.withColumn("token", F.lower("word")).join(frequency, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest")
    chosen = words.groupBy("found").agg(rarest)
    return windows.join(chosen, "found").select("found", "items", "rarest.token", "rarest.offset")


def word_frequency(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """How often each word of the windows occurs in all documents: token, n."""
    vocabulary = windows.select(F.explode("found").alias("word")).select(F.lower("word").alias("token")).distinct()
    said = docs.select(F.explode_outer(benchmark_words(F.col(text))).alias("word")).select(F.lower("word").alias("token"))
    return said.join(_small(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))


def _small(frame: DataFrame) -> DataFrame:
    """A hint to broadcast where the table was counted to be small enough."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _key(doc_id: str, text: str) -> Column:
    """What tells rows apart: null and repeated ids are told apart by their text."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text")).alias("key")


def window_hits(docs: DataFrame, prefix: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every occurrence of a window in a document: key, start (0 based), length, items."""
    rows = docs.select(_key(key, text), benchmark_words(F.col(text)).alias("words"))
    # The window as text: unlike a lambda over its words this stays in generated code,
    # where the document's words are referred to and not copied for each of them.
    prefix = prefix.select("token", "offset", "items", F.size("found").alias("size"), F.array_join("found", " ").alias("phrase"))
    size, begin = F.col("size"), F.col("place") - F.col("offset")
    within = (begin >= 0) & (begin + size <= F.size("words"))
    there = ascii_lower(F.array_join(F.slice("words", begin + 1, size), " "))
    if prefix.count() <= BROADCAST_ROWS:
        said = rows.select("key", "words", F.posexplode_outer("words").alias("place", "word"))
        met = said.join(F.broadcast(prefix), F.lower("word") == F.col("token"))
    else:
        said = rows.select("key", F.posexplode_outer("words").alias("place", "word"))
        met = said.join(prefix, F.lower("word") == F.col("token")).drop("word").join(rows, "key")
    met = met.where(within & F.when(within, there == F.col("phrase")).otherwise(False))
    return met.select("key", begin.alias("start"), size.alias("length"), "items")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    out: str = "contamination",
) -> DataFrame:
    """The documents with a struct column `out`: n_words, n_hit, items (found item ids), contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated
    with n_hit > 0 and 20 * n_hit >= n_words.
    """
    windows = stored(item_windows(items, size), "benchmark-windows")
    prefix = stored(prefixes(windows, word_frequency(docs, windows, text)), "benchmark-prefixes")
    hits = window_hits(docs, prefix, doc_id, text)
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    per_doc = hits.groupBy("key").agg(
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    per_doc = stored(per_doc.select("key", _covered("spans").alias("n_hit"), "items"), "benchmark-hits")
    none = F.array().cast(per_doc.schema["items"].dataType)
    # Only documents that may have a hit are shuffled to meet theirs; the texts of the others stay where they are.
    rows = marked(packed(docs, key=_key(doc_id, text)), per_doc.select("key"), "key", "maybe")
    hit = rows.where("maybe").join(per_doc, "key", "left").select("row", "n_hit", "items")
    free = rows.where("not maybe").select("row", F.lit(None).cast("long").alias("n_hit"), none.alias("items"))
    judged = hit.unionByName(free).withColumns(
        {
            "n_words": F.size(benchmark_words(F.col("row").getField(text))).cast("long"),
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
            "items": F.coalesce("items", none),
        }
    )
    judged = judged.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words")))
    judged = judged.withColumn("judged", F.struct("n_words", "n_hit", "items", "contaminated"))
    return unpacked(judged, docs.columns, **{out: "judged"})


def _covered(spans: str) -> Column:
    """Words inside the union of sorted (start, end) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct(
        (a["covered"] + F.greatest(s["end"] - F.greatest(a["reach"], s["start"]), F.lit(0))).alias("covered"),
        F.greatest(a["reach"], s["end"]).alias("reach"),
    )
    return F.aggregate(spans, zero, step)["covered"]
