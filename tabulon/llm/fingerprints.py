"""Document fingerprints: a homomorphic multiset hash that adds one wide vector per paragraph.

Paragraphs are lines; a long line is cut behind words that its own content chooses. Each paragraph is hashed to LANES whole numbers, quantised draws of a
Cauchy distribution, and the fingerprint is their sum modulo 2^BITS, lane by lane, followed by the number of paragraphs. So order does
not matter, the fingerprint of two texts together is the sum of theirs whatever they share, and inserting or deleting a paragraph adds or
subtracts its vector without a look at the rest. Cauchy draws are 1-stable: a lane of the difference of two fingerprints is one draw, as wide as the number of copies
of paragraphs that one text has and the other lacks, so that number is estimated from the lanes of the difference.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import free_name

LANES = 256
#: Bits of a lane: room for draws up to 2^35, in steps of 1 / SCALE.
BITS = 40
SCALE = 1 << 4
MODULUS = 1 << BITS
LONGEST_DRAW = 1 << (BITS - 2)
#: Paragraphs whose draws are made at once.
BLOCK = 256
#: One word in so many ends a piece of a line.
CUT = 8
SEED = 17
ROUNDS = 4
#: Blocks of neighbours for each partition of a shuffle, so that a hash deals them evenly, and documents that a block has at least, as a rule: its first one moves twice.
BLOCKS_A_PARTITION = 64
ROWS_A_BLOCK = 16
#: Rows that a task gives at once.
ROWS_AT_ONCE = 1024


def paragraphs(text: str) -> list[bytes]:
    """The pieces of a text, as bytes. Lines do not depend on each other."""
    out = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split(b" ")
        begin = 0
        for at, code in enumerate(map(zlib.crc32, words)):
            if code % CUT == 0 and words[at]:
                out.append(b" ".join(words[begin : at + 1]))
                begin = at + 1
        if any(words[begin:]):
            out.append(b" ".join(words[begin:]))
    return out


def _cauchy(uniform: np.ndarray) -> np.ndarray:
    """Quantised Cauchy draws for 32 uniform bits."""
    draws = SCALE * np.tan(np.pi * ((uniform.astype(float) + 0.5) / 2**32 - 0.5))
    return np.clip(np.rint(draws), -LONGEST_DRAW, LONGEST_DRAW).astype(np.int64)


#: Draws by the upper 16 bits; in the tails, where they lie far apart, all 32 bits count, and the table has 0.
TAIL = 32
_TABLE = _cauchy((np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)) + np.uint32(1 << 15)).astype(np.int32)
_TABLE[:TAIL] = _TABLE[-TAIL:] = 0
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, (4, LANES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sums_of(pieces: list[bytes]) -> np.ndarray:
    """The sums of LANES draws per paragraph: each lane mixes the 128 bits of a paragraph's digest in its own way."""
    digest = hashlib.blake2b
    digests = np.frombuffer(b"".join([digest(p, digest_size=16).digest() for p in pieces]), "<u4").reshape(-1, 4)
    mixed = digests[:, :1] * _FACTORS[0]
    for i in (1, 2, 3):
        mixed += digests[:, i : i + 1] * _FACTORS[i]
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    upper = mixed >> np.uint32(16)
    out = _TABLE.take(upper).sum(0, dtype=np.int64)
    far = np.flatnonzero(upper - np.uint32(TAIL) >= np.uint32((1 << 16) - 2 * TAIL))
    if len(far):
        np.add.at(out, far % LANES, _cauchy(mixed.ravel()[far]))
    return out


def fingerprint_of(pieces: list[bytes]) -> np.ndarray:
    """LANES sums modulo 2^BITS, and the count."""
    sums = np.zeros(LANES, np.int64)
    for begin in range(0, len(pieces), BLOCK):
        sums += sums_of(pieces[begin : begin + BLOCK])
    return np.append(sums % MODULUS, len(pieces))


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of both multisets together."""
    return np.append((a[:LANES] + b[:LANES]) % MODULUS, a[LANES] + b[LANES])


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of a without the paragraphs of b, which a has."""
    return np.append((a[:LANES] - b[:LANES]) % MODULUS, a[LANES] - b[LANES])


def changed(fingerprint: np.ndarray, before: list[bytes], after: list[bytes]) -> np.ndarray:
    """The fingerprint of after from that of before: only the paragraphs that differ are hashed."""
    same = next((i for i, (a, b) in enumerate(zip(before, after)) if a != b), min(len(before), len(after)))
    old, new = Counter(before[same:]), Counter(after[same:])
    gone, come = list((old - new).elements()), list((new - old).elements())
    return add(remove(fingerprint, fingerprint_of(gone)), fingerprint_of(come))


def _signed(lanes: np.ndarray) -> np.ndarray:
    return np.where(lanes >= MODULUS // 2, lanes - MODULUS, lanes)


def to_bytes(fingerprint: np.ndarray) -> bytes:
    """The lanes' low bytes first and their high bytes, which are mostly 0 with the sign in the lowest bit, last; then the count."""
    signed = _signed(fingerprint[:LANES])
    lanes = (signed << 1 ^ signed >> 63).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    return lanes.T.tobytes() + fingerprint[LANES:].astype("<i8").tobytes()


def from_bytes(value: bytes) -> np.ndarray:
    lanes = np.zeros((LANES, 8), np.uint8)
    lanes[:, : BITS // 8] = np.frombuffer(value, np.uint8, BITS // 8 * LANES).reshape(-1, LANES).T
    folded = lanes.view("<i8").ravel()
    return np.append((folded >> 1 ^ -(folded & 1)) % MODULUS, np.frombuffer(value, "<i8", 1, BITS // 8 * LANES))


def to_text(fingerprint: np.ndarray) -> str:
    return to_bytes(fingerprint).hex()


def from_text(value: str) -> np.ndarray:
    return from_bytes(bytes.fromhex(value))


def differing(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated number of copies of paragraphs that one has and the other lacks; 0 for equal fingerprints, about a tenth off else.

    The most likely width of the Cauchy distribution that the lanes of the difference were drawn from.
    """
    squares = _signed((a[:LANES] - b[:LANES]) % MODULUS).astype(float) ** 2
    width = float(np.median(squares))
    for _ in range(ROUNDS if width else 0):
        weights = 1 / (squares + width)
        width = float((squares * weights).sum() / weights.sum())
    return width**0.5 / SCALE


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 - (estimated number of differing paragraphs) / (paragraphs of both), between 0 and 1; 1 for two empty ones."""
    both = int(a[LANES]) + int(b[LANES])
    return float(np.clip(1 - differing(a, b) / both, 0, 1)) if both else 1.0


def fingerprints(df: DataFrame, text: str, out: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of the whole text as hex; a null text counts as empty; a column out is replaced, all others stay.

    Equal texts, and texts with the same paragraphs in another order, have equal fingerprints; equal rows get one each, an empty table
    gives none. A text of any length takes its own bytes and some KB for a block of paragraphs. No shuffle.
    """
    rows = df.drop(out)
    whole = free_name([*df.columns, out], "text")

    def added(batches):
        for batch in batches:
            at = batch.schema.get_field_index(whole)
            values = [to_text(fingerprint_of(paragraphs(v.as_py() or ""))) for v in batch.column(at)]
            yield batch.remove_column(at).append_column(out, pa.array(values, pa.string()))

    return df.select(*rows.columns, F.col(text).alias(whole)).mapInArrow(added, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, text): an id and h, a hash of the text, name a document."""
    id_column = F.col(doc_id) if df.schema[doc_id].dataType.typeName() == "string" else F.col(doc_id).cast("bigint")
    docs = df.select(id_column.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return docs.withColumn("h", F.xxhash64("text"))


def _key(doc_id: int | str | None, h: int) -> tuple:
    """Documents are in descending order of their keys: null ids last, equal ids by the hash of the text."""
    return (False, 0, ~h) if doc_id is None else (True, doc_id, ~h)


def block_starts(keyed: DataFrame) -> list[tuple]:
    """The keys of the documents that begin a block of neighbours, ascending: those that a hash draws, some BLOCKS_A_PARTITION for each partition of a shuffle, whatever the rows."""
    rows, partitions = keyed.count(), int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one_in = max(1, rows // (BLOCKS_A_PARTITION * partitions), min(ROWS_A_BLOCK, rows // partitions))
    ids = keyed.select("doc_id", "h")
    drawn = ids.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(one_in)) == 0).distinct().collect() or ids.take(1)
    return sorted(_key(*row) for row in drawn)


def compare_with_edit(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text has its last third of code points replaced by the first as many (or all) of the next document
    in descending id; ids may be whole numbers or text. Null texts are empty, a null id comes last, equal ids are ordered by the hash of the text, equal rows
    follow each other and count each, a single row is its own next; an empty table gives no rows; other columns are left out. Each document moves once, compressed,
    to the block of its neighbours, where it is fingerprinted once, for itself and as the next one; only the first of a block goes to the block before as well. A text of
    any length is held in one task with its neighbour.
    """
    keyed = _keyed(df, doc_id, text)
    id_field = keyed.schema["doc_id"]
    id_kind, arrow_id = (id_field.dataType.simpleString(), pa.string() if id_field.dataType.typeName() == "string" else pa.int64())
    starts = block_starts(keyed)
    moved = pa.schema([("block", pa.int32()), ("lap", pa.int32()), ("doc_id", arrow_id), ("h", pa.int64()), ("z", pa.binary()), ("n", pa.int64())])

    def placed(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part, out = batch.slice(begin, ROWS_AT_ONCE), []
                for key, h, value in zip(*(part.column(i) for i in range(3)), strict=True):
                    key, h, data = key.as_py(), h.as_py(), value.as_py().encode("utf-8", "surrogatepass")
                    row = (key, h, pa.compress(data, codec="zstd", asbytes=True), len(data))
                    own = _key(key, h)
                    at = bisect_left(starts, own)
                    # Documents before the first block are the end of the last one, so the order is a circle.
                    out.append((at, 0, *row) if at < len(starts) else (0, 1, *row))
                    if at < len(starts) and starts[at] == own:
                        out.append(((at + 1) % len(starts), 2, *row))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), moved.types, strict=True)], schema=moved)

    rows = keyed.select("doc_id", "h", "text").mapInArrow(placed, f"block int, lap int, doc_id {id_kind}, h bigint, z binary, n bigint")
    ordered = rows.repartition("block").sortWithinPartitions("block", "lap", F.col("doc_id").desc_nulls_last(), F.col("h").asc())
    result = pa.schema(
        [("doc_id", arrow_id), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def compared(batches):
        before, out = None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(name)) for name in ("block", "lap", "doc_id", "z", "n")]
            for block, lap, key, z, n in zip(*columns, strict=True):
                block, lap, size = block.as_py(), lap.as_py(), n.as_py()
                if lap == 2 and before is None:
                    # A copy of the first of the next block, whose neighbour has met it.
                    continue
                value = (pa.decompress(z.as_py(), decompressed_size=size, codec="zstd", asbytes=True) if size else b"").decode("utf-8", "surrogatepass")
                found = _Halves(block, key.as_py(), value)
                if before is not None:
                    out.append(before.beside(found))
                before = found if lap < 2 else None
                if len(out) >= ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), result.types, strict=True)], schema=result)
                    out = []
        if before is not None:
            raise ValueError(f"block {before.block} ends without the first document of the next one")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), result.types, strict=True)], schema=result)

    return ordered.mapInArrow(
        compared, f"doc_id {id_kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


class _Halves:
    """A document with the fingerprints of the lines that end before its edit, and of the rest."""

    def __init__(self, block: int, doc_id: int | str | None, value: str):
        self.block, self.doc_id, self.value = block, doc_id, value
        self.kept = len(value) - len(value) // 3
        # Lines that end before the edit are in both texts.
        self.line = value.rfind("\n", 0, self.kept) + 1
        self.tail = paragraphs(value[self.line :])
        self.shared, self.own = fingerprint_of(paragraphs(value[: self.line])), fingerprint_of(self.tail)
        self.whole = add(self.shared, self.own)

    def beside(self, following: _Halves) -> tuple:
        """The row of the result, given the next document."""
        if following.block != self.block:
            raise ValueError(f"block {self.block} ends without the first document of the next one")
        edited = self.value[: self.kept] + following.value[: len(self.value) - self.kept]
        changed_to = add(self.shared, changed(self.own, self.tail, paragraphs(edited[self.line :])))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(self.whole, changed_to), likeness(self.whole, following.whole)
        return (self.doc_id, len(self.value), digest, to_text(self.whole), to_text(changed_to), *near)
