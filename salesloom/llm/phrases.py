"""Operator 13: collocations, found by Rabin-Karp fingerprints of every word sequence.

A text is cut into pieces and words in the bytes of its UTF-8 form. One prefix
polynomial over those bytes, computed by numpy for some megabytes of texts at a
time, gives the fingerprint of any sequence of words by a subtraction and a
product. A language enters as a digest of its name, and a word longer than FAR bytes by one
of its own: patterns that cancel out modulo 2^64 for every base (Thue-Morse) need 1024 bytes.
Fingerprints are counted level by level: a sequence of k words can occur
often only if both of its parts of k - 1 words do, so the words are counted
first and each next level fingerprints only what may still be frequent. A task
adds up what it sees before the shuffle, so a very common phrase is one entry a task.

The shuffle carries fingerprint, count and a pointer to an occurrence: the bucket of
documents (by checksum of the text) that holds one, the lowest of all. The entries of a
task lie sorted in blobs, one per range of fingerprints, as differences and
byte by byte, which compresses to some seven bytes each. There are RANGES times as
many ranges as splits of the input, so what one range gathers does not grow.

Pointers then resolve the frequent fingerprints: only documents of the pointed bucket
turn a fingerprint into text. Last, every occurrence of a frequent fingerprint is
verified against that text by a second polynomial over its bytes; what differs, a
collision, is counted by its own text and taken from the count of the other.

What is frequent, pointed to or verified is handed to the tasks as a filter of 2^BITS
bits, a fixed size. With many more fingerprints than bits it lets others through,
which costs shuffling in the first two uses; what is let through is told apart by
exact joins afterwards. Only in the last could it hide a collision of 64 bits.

Defined results: a null text is empty and has no words; a null language is `und`
and one with a language of that name; texts of any length are read whole, a
text longer than CHUNK in one go; repeated rows are counted each; equal scores
are ordered by count, then by phrase in the order of its bytes; an empty
table gives an empty table; extra columns are not used. Sequences never cross a
piece, so never a text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from salesloom.session import stored

LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a phrase
COVERED = 80  # percent: a longer phrase this frequent stands for those inside it
BITS = 26  # of a filter of fingerprints: 8 MB
CHUNK = 500_000  # bytes of text fingerprinted in one go
HELD = 1_000_000  # fingerprints a task adds up before it hands them on
FAR = 64  # bytes of a word from which its digest counts as well
RANGES = 16  # of fingerprints, per split of the input
BUCKETS = 1 << 12  # of documents, for pointers
SHARDS = 64  # parts of a language ranked on their own first

_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses modulo 2^64
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CUTS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_UPPER + b"\t" + _CUTS, _UPPER.lower() + b" " + b"\n" * len(_CUTS))
_BLANK, _CUT = 0x20, 0x0A


@dataclass
class Sequences:
    """Words of some texts, ready to give the fingerprint of any sequence of them."""

    packed: np.ndarray  # bytes of the words, one blank after each
    start: np.ndarray  # of each word in packed
    end: np.ndarray
    piece: np.ndarray  # number of the piece that holds the word
    text: np.ndarray  # number of the text that holds the word
    place: np.ndarray  # byte of the text where the word begins
    bucket: np.ndarray  # of documents, by text
    salt: np.ndarray  # of the language, by word
    far: np.ndarray  # words longer than FAR
    digests: np.ndarray  # of those, one column per polynomial
    prefix: np.ndarray  # polynomial over packed, before each byte
    width: int = 64  # bits of a fingerprint
    second: np.ndarray | None = None

    def fingerprints(self, words: int) -> np.ndarray:
        """Of the sequences of so many words, by their first word; those that cross a piece have one, too."""
        n = len(self.start) - words + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        inverse = _powers(_BASE, len(self.packed) + 1)[1]
        first = self.start[:n]
        value = (self.prefix[self.end[words - 1 :]] - self.prefix[first]) * inverse[first]
        return _mixed(value ^ self.salt[:n]) >> np.uint64(64 - self.width) << np.uint64(64 - self.width)

    def checks(self, words: int, at: np.ndarray) -> np.ndarray:
        """By a second polynomial over bytes and the language, of the sequences that begin at some words."""
        if self.second is None:
            self.second = _prefix(self.packed, _SECOND, self.start[self.far], self.digests[:, 1])
        inverse = _powers(_SECOND, len(self.packed) + 1)[1]
        first = self.start[at]
        return _mixed((self.second[self.end[at + words - 1]] - self.second[first]) * inverse[first] ^ _mixed(self.salt[at]))

    def whole(self, words: int) -> np.ndarray:
        """Whether the sequence of so many words from each word lies in one piece."""
        n = max(len(self.start) - words + 1, 0)
        return self.piece[:n] == self.piece[words - 1 :][:n]


def sequences(texts: list[bytes], salts: np.ndarray, width: int = 64) -> Sequences:
    """Pieces and words of texts in UTF-8; `salts` holds one number per text, of its language."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.translate(_FOLD), np.uint8)
    cut = data == _CUT
    word = ~cut & (data != _BLANK)
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    after = np.zeros(len(data), bool)
    after[stop] = True
    packed = data[word | after].copy()
    size = stop - begin + 1
    start = np.cumsum(size) - size
    end = start + size - 1
    packed[end] = _BLANK
    bounds = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(bounds, begin, side="right")
    opened = np.concatenate([[0], bounds[:-1]])
    bucket = np.array([zlib.crc32(t) % BUCKETS for t in texts], np.int64)
    far = np.flatnonzero(size - 1 > FAR)
    digests = np.array([_digest(packed[start[k] : end[k]].tobytes()) for k in far], np.uint64).reshape(-1, 2)
    prefix = _prefix(packed, _BASE, start[far], digests[:, 0])
    return Sequences(packed, start, end, np.cumsum(cut)[begin], text, begin - opened[text], bucket, salts[text], far, digests, prefix, width)


def _prefix(data: np.ndarray, base: int, at: np.ndarray, added: np.ndarray) -> np.ndarray:
    """The polynomial over bytes before each byte; where a word begins that is longer than FAR, its digest is added."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    out[1:] = data
    out[1:] += np.uint64(1)
    out[1 + at] += added
    out[1:] *= _powers(base, len(data))[0]
    return np.cumsum(out, out=out)


def _digest(data: bytes) -> tuple[int, int]:
    """Two numbers of 64 bits."""
    found = blake2b(data, digest_size=16).digest()
    return int.from_bytes(found[:8]), int.from_bytes(found[8:])


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, made once per process and grown when needed."""
    known = _known.get(base)
    if known is None or len(known[0]) < size:
        factors = [np.full(2 * size + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for f in factors:
            f[0] = 1
        known = _known[base] = (np.cumprod(factors[0]), np.cumprod(factors[1]))
    return known[0][:size], known[1][:size]


_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads what differs over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _salt(lang: str) -> int:
    """A number of the language, in which similar names have no bits in common with those of similar words."""
    return _digest(lang.encode())[0]


class Filter:
    """One bit per frequent fingerprint of a level, in a table of fixed size."""

    def __init__(self, rows: pa.Table, bits: int):
        self.table = np.zeros(1 << (bits - 6), np.uint64)
        self.table[rows["row"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        word = self.table[(keys >> np.uint64(6)) & np.uint64(len(self.table) - 1)]
        return (word >> (keys & np.uint64(63))) & np.uint64(1) == 1


def filter_rows(keys: DataFrame, bits: int) -> DataFrame:
    """The filter of the fingerprints in `key` as rows of 64 bits: (row, bits)."""
    row = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1).cast("long"))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    return keys.select(row.alias("row"), bit.alias("bit")).groupBy("row").agg(F.bit_or("bit").alias("bits"))


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[Sequences, list[str], list]]:
    """Sequences, languages and ids of some documents, about CHUNK bytes together, those of low buckets first."""
    for batch in batches:
        texts, langs, ids = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        size, held = 0, []
        for k, text in enumerate(texts):
            held.append((text.as_buffer().to_pybytes() if text.is_valid else b"", k))
            size += len(held[-1][0])
            if size >= CHUNK or k + 1 == len(texts):
                held.sort(key=lambda t: zlib.crc32(t[0]) % BUCKETS)
                names = [langs[k] for _, k in held]
                salts = {lang: _salt(lang) for lang in set(names)}
                found = sequences([t for t, _ in held], np.array([salts[n] for n in names], np.uint64), width)
                yield found, names, ids.take(pa.array([k for _, k in held])).to_pylist()
                size, held = 0, []


def _maybe(found: Sequences, words: int, filters: list[Filter]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of so many words, as number of the first word and fingerprint, whose two parts may be frequent."""
    if words == 1:
        keys = found.fingerprints(1)
        return np.arange(len(keys)), keys
    part = filters[words - 2].has(found.fingerprints(words - 1))
    at = np.flatnonzero(found.whole(words) & part[:-1] & part[1:]) if len(part) > 1 else np.empty(0, np.int64)
    return at, found.fingerprints(words)[at]


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints once each, in order, with the sum of their counts and the least of their buckets."""
    keys, counts, buckets = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    if not len(first):
        return keys, counts, buckets
    return keys[first], np.add.reduceat(counts[order], first), np.minimum.reduceat(buckets[order], first)


def _blobs(entries: tuple[np.ndarray, np.ndarray, np.ndarray], shift: int) -> pa.RecordBatch:
    """Sorted entries in one blob per range of fingerprints; a range is what is left of a fingerprint after the shift."""
    keys, counts, buckets = entries
    ranges = (keys >> np.uint64(shift)).astype(np.int64)
    cut = np.flatnonzero(np.diff(ranges, prepend=-1))
    blobs = []
    for a, b in zip(cut, [*cut[1:], len(keys)]):
        steps = np.diff(keys[a:b], prepend=np.uint64(0))
        blobs.append(b"".join([_planes(steps), _planes(counts[a:b].astype(np.uint64)), _planes(buckets[a:b].astype(np.uint64))]))
    return pa.record_batch([pa.array(ranges[cut]), pa.array(blobs, pa.binary())], ["range", "blob"])


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of eight bytes, first the first byte of all, then the second of all: equal bytes lie together."""
    return numbers.view(np.uint8).reshape(-1, 8).T.tobytes()


def _entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(3, 8, -1)
    steps, counts, buckets = (np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes)
    return np.cumsum(steps), counts.astype(np.int64), buckets.astype(np.int64)


def _level(docs: DataFrame, words: int, filters: list, least: int, width: int) -> DataFrame:
    """Fingerprints of so many words that occur often enough: words, key, a and the pointer to an occurrence."""
    bits = max(1, (RANGES * docs.rdd.getNumPartitions() - 1).bit_length())
    shift = 64 - min(bits, 40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        parts, held = [], 0
        for found, _, _ in _read(batches, width):
            at, seen = _maybe(found, words, known)
            unique, first, n = np.unique(seen, return_index=True, return_counts=True)
            parts.append((unique, n, found.bucket[found.text[at[first]]]))
            held += len(unique)
            if held >= HELD:
                parts = [_added(parts)]
                held = len(parts[0][0])
                if 2 * held >= HELD:
                    yield _blobs(parts[0], shift)
                    parts, held = [], 0
        if held:
            yield _blobs(_added(parts), shift)

    def add(blobs: pa.Table) -> pa.Table:
        keys, counts, buckets = _added([_entries(b.as_py()) for b in blobs.column("blob")])
        often = counts >= least
        keys, counts, pointing = keys[often], counts[often], _pointing(keys[often], buckets[often])
        return pa.table({"words": np.full(len(keys), words, np.int32), "key": keys.view(np.int64), "a": counts, "pointing": pointing.view(np.int64)})

    return docs.mapInArrow(run, "range long, blob binary").groupBy("range").applyInArrow(add, "words int, key long, a long, pointing long")


def _texts(docs: DataFrame, longest: int, often: list, pointed, width: int) -> DataFrame:
    """Texts of the fingerprints whose pointer leads here, and with words = 0 how many words each language has."""
    kind = docs.schema["id"].dataType
    schema = f"lang string, words int, key long, phrase string, code long, a long, id {kind.simpleString()}, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, here = [f.value for f in often], pointed.value
        totals: Counter = Counter()
        for found, langs, ids in _read(batches, width):
            for lang, n in zip(langs, np.bincount(found.text, minlength=len(langs)).tolist()):
                totals[lang] += n
            rows = []
            for words in range(1, longest + 1):
                at, keys = _maybe(found, words, known)
                some = np.flatnonzero(here.has(_pointing(keys, found.bucket[found.text[at]])))
                some = some[np.unique(keys[some], return_index=True)[1]]
                for k, key, code in zip(at[some].tolist(), keys[some].view(np.int64).tolist(), found.checks(words, at[some]).view(np.int64).tolist()):
                    text = found.text[k]
                    phrase = found.packed[found.start[k] : found.end[k + words - 1]].tobytes().decode()
                    rows.append((langs[text], words, key, phrase, code, None, ids[text], int(found.place[k])))
            if rows:
                yield _batch(rows, kind)
        if any(totals.values()):
            yield _batch([(lang, 0, 0, "", 0, n, None, 0) for lang, n in totals.items() if n], kind)

    return docs.mapInArrow(run, schema)


def _pointing(keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Fingerprint and bucket in one number."""
    return keys ^ _mixed(buckets.astype(np.uint64) + np.uint64(1))


def _strays(docs: DataFrame, longest: int, often: list, verified, width: int) -> DataFrame:
    """Occurrences of frequent fingerprints whose text is not the verified one: lang, words, key, phrase, a, id, place."""
    kind = docs.schema["id"].dataType
    schema = f"lang string, words int, key long, phrase string, code long, a long, id {kind.simpleString()}, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, right = [f.value for f in often], verified.value
        for found, langs, ids in _read(batches, width):
            rows = []
            for words in range(1, longest + 1):
                at, keys = _maybe(found, words, known)
                some = known[words - 1].has(keys)
                at, keys = at[some], keys[some]
                wrong = np.flatnonzero(~right.has(keys ^ found.checks(words, at)))
                for k, key in zip(at[wrong].tolist(), keys[wrong].view(np.int64).tolist()):
                    text = found.text[k]
                    phrase = found.packed[found.start[k] : found.end[k + words - 1]].tobytes().decode()
                    rows.append((langs[text], words, key, phrase, 0, 1, ids[text], int(found.place[k])))
            if rows:
                yield _batch(rows, kind)

    return docs.mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: T.DataType) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), to_arrow_type(kind), pa.int64()]
    columns = [pa.array([row[k] for row in rows], t) for k, t in enumerate(types)]
    return pa.record_batch(columns, ["lang", "words", "key", "phrase", "code", "a", "id", "place"])


def frequent_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id: str = "doc_id",
    longest: int = LONGEST,
    least: int = LEAST,
    bits: int = BITS,
    width: int = 64,
) -> DataFrame:
    """Phrases of 1 to `longest` words that occur `least` times in a language: lang, words, phrase, a, id, place.

    `id` and `place` point to one occurrence: the document and the byte of its text.
    A row with words = 0 holds the number of all word occurrences of its language. A
    fingerprint has `width` bits; fewer make more collisions and no other result.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(id).alias("id"))
    filters, levels = [], []
    for words in range(1, longest + 1):
        levels.append(stored(_level(named, words, filters, least, width), "fingerprints"))
        filters.append(_filter(spark, levels[-1].select("key"), bits))
    frequent = reduce(DataFrame.unionByName, levels)
    pointed = _filter(spark, frequent.select(F.col("pointing").alias("key")), bits)
    found = stored(_texts(named, longest, filters, pointed, width), "texts")
    least_text = F.min(F.struct("phrase", "lang", "code", "id", "place")).alias("t")
    texts = stored(found.where("words > 0").groupBy("words", "key").agg(least_text).join(frequent, ["words", "key"]), "verified")
    verified = _filter(spark, texts.select(F.expr("key ^ t.code").alias("key")), bits)
    strays = _strays(named, longest, filters, verified, width).join(texts.select("words", "key"), ["words", "key"])
    strays = stored(strays.groupBy("lang", "words", "key", "phrase").agg(F.sum("a").alias("a"), F.min(F.struct("id", "place")).alias("t")), "strays")
    less = strays.groupBy("words", "key").agg(F.sum("a").alias("less"))
    true = texts.join(less, ["words", "key"], "left").withColumn("a", F.col("a") - F.coalesce("less", F.lit(0)))
    phrases = true.select("t.lang", "words", "t.phrase", "a", "t.id", "t.place").unionByName(strays.select("lang", "words", "phrase", "a", "t.id", "t.place"))
    totals = found.where("words = 0").groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"), F.min("id").alias("id"), F.min("place").alias("place"))
    return phrases.where(F.col("a") >= least).unionByName(totals)


def _filter(spark: SparkSession, keys: DataFrame, bits: int):
    """The filter as a variable of every executor: at most 2^bits bits."""
    return spark.sparkContext.broadcast(Filter(filter_rows(keys, bits).toArrow(), bits))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id: str = "doc_id",
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED,
    top: int = 2000,
    bits: int = BITS,
    width: int = 64,
) -> DataFrame:
    """The `top` phrases of each language by how closely their weakest cut holds: lang, rank, phrase, a, l, r, n, score, id, place.

    A cut after k words has the score floor(2000000 * a / (l + r)) with the counts l and r of
    its two parts; the lowest cut counts. A phrase inside a longer one that occurs at
    least `covered` percent as often is left out. Products are decimals, so that none overflows.
    """
    found = stored(frequent_phrases(docs, text, lang, id, longest, least, bits, width), "phrases")
    words = F.split("phrase", " ")
    phrases = found.where("words > 1")
    parts = found.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = phrases.select("lang", "phrase", "a", "id", "place", words.alias("ws"), cut.alias("k"))
    sides = cuts.select("*", _joined("ws", F.lit(1), F.col("k")).alias("left"), _joined("ws", F.col("k") + 1, F.size("ws") - F.col("k")).alias("right"))
    lefts, rights = (parts.select("lang", F.col("part").alias(side), F.col("f").alias(count)) for side, count in (("left", "l"), ("right", "r")))
    scored = sides.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    weakest = scored.groupBy("lang", "phrase", "a", "id", "place").agg(lowest.alias("cut"))
    inner = phrases.where("words > 2").select("lang", "a", words.alias("ws"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)).alias("from"))
    longer = inner.groupBy("lang", _joined("ws", F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    over = F.expr(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(covered)}")
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(over)
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), "id", "place")
    totals = found.where("words = 0").select("lang", F.col("a").alias("n"))
    best = _best(kept, top).join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "id", "place")


def _joined(ws: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.col(ws), start, size), " ")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language with their rank: first of each shard, then of what the shards leave."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS)).alias("shard")
    place = F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*order))
    few = rows.select("*", shard).withColumn("rank", place).where(F.col("rank") <= top).drop("shard", "rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= top)
