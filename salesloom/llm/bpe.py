"""Operator 2: BPE encoding and decoding with content-defined chunk reuse.

Each text is cut where a rolling hash of its last 16 bytes hits a pattern, so
equal passages of different documents give equal chunks wherever they stand. A
task encodes each chunk once and reuses its ids (a least-recently-used table of
bounded size). Chunks encoded apart differ from the whole text only around their
joins: there the text between two safe places, one on either side of the join,
is encoded again until both encodings have a token boundary at both places, and
the ids are spliced. A safe place is white space right after another character,
where the pre-tokenizer always begins a new piece.

Reuse is per task: encoding each chunk once for the whole corpus would shuffle
all chunk texts and all ids, about twice the input on disk, for fewer encodings
of the small part that recurs (see README for figures). So there is no shuffle,
no hot key, and a lost executor costs its own tasks only.

Defined results: a null text is encoded as the empty text; an empty text has no
tokens; very long texts are encoded whole; repeated rows are encoded each; an
empty table gives an empty table; extra columns of any name pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

SPAN = 16  # bytes under the rolling hash
MEAN_BITS = 12  # a cut each 4,096 bytes on average
LEAST = 512  # bytes of a chunk at least
BLOCK = 1 << 20  # bytes hashed at a time
KEPT = 8_192  # chunks whose ids a worker keeps
END = "<|endoftext|>"
# Beyond these characters two libraries' Unicode tables may differ; such texts go to `tokenizers` itself.
PLAIN = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")


@dataclass(frozen=True)
class Vocabulary:
    """Where every executor finds a byte-level vocabulary: for `tokenizers`, and the same as ranks."""

    json_path: str
    ranks_path: str
    pattern: str


def public_vocabulary() -> Vocabulary:
    """The public byte-level vocabulary with 50,257 entries."""
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def chunk_cuts(raw: bytes) -> list[int]:
    """Byte offsets of the chunks, 0 and the length included; cuts stand before whole characters."""
    n = len(raw)
    data = np.frombuffer(raw, np.uint8)
    table = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    cuts = [0]
    for at in range(0, n - SPAN, BLOCK):
        rolled = table[data[at : at + BLOCK + SPAN - 1]]
        width, factor = 1, 0x01000193
        while width < SPAN and len(rolled) > width:  # each round doubles the bytes under the hash
            rolled = rolled[:-width] * np.uint32(factor) + rolled[width:]
            width, factor = width * 2, factor * factor & 0xFFFFFFFF
        if width < SPAN:
            break
        places = np.flatnonzero(rolled >> np.uint32(32 - MEAN_BITS) == 0) + (at + SPAN)
        places = places[places < n]
        for p in places[data[places] & 0xC0 != 0x80].tolist():
            if p - cuts[-1] >= LEAST and n - p >= LEAST:
                cuts.append(p)
    return [*cuts, n]


def safe_places(raw: bytes) -> np.ndarray:
    """Byte offsets where white space follows another character, ends of the text included."""
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    plain = (data >= 0x21) & (data <= 0x7E)
    letter = np.zeros(len(data), bool)  # second bytes of characters from U+00C0 to U+07FF
    letter[1:] = (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    found = np.flatnonzero(space[1:] & (plain | letter)[:-1]) + 1
    return np.concatenate(([0], found, [len(data)]))


class Encoder:
    """Chunked encoding with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        with open(vocabulary.ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.exact = Tokenizer.from_file(vocabulary.json_path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.fast = tiktoken.Encoding("given", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={END: len(ranks)})
        self.sizes = np.zeros(len(ranks) + 1, np.int64)
        for piece, rank in ranks.items():
            self.sizes[rank] = len(piece)
        self.sizes[len(ranks)] = len(END)
        self.kept: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.reused = self.encoded = 0

    def ids_of(self, text: str) -> np.ndarray:
        """Ids of a text in one go, without chunks."""
        if PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def chunk(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and the byte after each, reused where the same chunk came before."""
        key = hashlib.blake2b(chunk, digest_size=16).digest()
        found = self.kept.get(key)
        if found is not None:
            self.kept.move_to_end(key)
            self.reused += 1
            return found
        self.encoded += 1
        ids = self.ids_of(chunk.decode())
        found = self.kept[key] = ids, np.cumsum(self.sizes[ids])
        if len(self.kept) > KEPT:
            self.kept.popitem(last=False)
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, equal to encoding it in one go."""
        raw = text.encode()
        cuts = chunk_cuts(raw)
        parts = [self.chunk(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
        if len(parts) == 1:
            return parts[0][0]
        ids = np.concatenate([p[0] for p in parts])
        ends = np.concatenate([[0], *(p[1] + c for p, c in zip(parts, cuts))])
        return self._repaired(raw, cuts[1:-1], ids, ends)

    def _repaired(self, raw: bytes, joins: list[int], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Replaces the ids around each join by those of re-encoded text; ends[i] is the byte where ids[i] begins."""
        safe = safe_places(raw)
        out, begin = [], 0  # text up to byte `begin` is done
        at = 0
        while at < len(joins):
            low = max(int(np.searchsorted(safe, joins[at], "right")) - 1, int(np.searchsorted(safe, begin)))
            high = int(np.searchsorted(safe, joins[at]))
            while True:
                reach = at + 1
                while reach < len(joins) and joins[reach] < safe[high]:  # the repair runs over further joins
                    reach += 1
                agreed = self._window(raw, safe, low, high, ids, ends)
                if agreed is not None:
                    break
                low, high = max(low - 1, int(np.searchsorted(safe, begin))), min(high + 1, len(safe) - 1)
            out += [ids[np.searchsorted(ends, begin) : np.searchsorted(ends, safe[low])], agreed]
            begin, at = int(safe[high]), reach
        out.append(ids[np.searchsorted(ends, begin) :])
        return np.concatenate(out)

    def _window(self, raw: bytes, safe: np.ndarray, low: int, high: int, ids: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """New ids between two safe places, or None while the text on either side does not come out as before."""
        outer_low, outer_high = max(low - 1, 0), min(high + 1, len(safe) - 1)
        begin, left, right, end = (int(safe[k]) for k in (outer_low, low, high, outer_high))
        new = self.ids_of(raw[begin:end].decode())
        bounds = np.concatenate([[begin], begin + np.cumsum(self.sizes[new])])
        a, b = (int(np.searchsorted(bounds, p)) for p in (left, right))
        p, q, r, s = (int(np.searchsorted(ends, x)) for x in (begin, left, right, end))
        cut_there = bounds[a] == left and bounds[b] == right and ends[q] == left and ends[r] == right
        before = low == 0 or (ends[p] == begin and np.array_equal(new[:a], ids[p:q]))
        after = high == len(safe) - 1 or (ends[s] == end and np.array_equal(new[b:], ids[r:s]))
        return new[a:b] if cut_there and before and after else None

    def decode(self, ids: np.ndarray) -> str:
        return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: Vocabulary) -> Encoder:
    """One per Python worker."""
    return Encoder(vocabulary)


def _texts(batch: pa.RecordBatch, text: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """The documents with their ids, array<int>, in column `out`.

    `decoded` names a column for the SHA-256 of the text that the ids decode to.
    """
    names = [c for c in docs.columns if c not in (out, decoded)]
    given = docs.select(*names)
    fields = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            ids = [tool.encode(t).astype(np.int32) for t in _texts(batch, text)]
            column = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate([np.zeros(0, np.int32), *ids]))
            added = [pa.array([hashlib.sha256(tool.decode(i).encode()).hexdigest() for i in ids], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, column, *added], [*names, *(f.name for f in fields)])

    return given.mapInArrow(run, T.StructType([*given.schema.fields, *fields]))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (little-endian unsigned 32 bit), decoded_sha256 (UTF-8)."""
    given = docs.select(key, text)
    kind = given.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            sizes, coded, decoded = [], [], []
            for t in _texts(batch, text):
                ids = tool.encode(t)
                sizes.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return given.mapInArrow(run, schema)
