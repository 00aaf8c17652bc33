"""Removal of repeated byte strings with a sampled suffix array.

A string of LENGTH bytes repeats if it starts at two places of the corpus. Of the suffixes in each such string one is a sample: the one whose first LEAD
bytes have the least hash, so equal strings sample the same place. A sample stands for a block, the neighbouring strings that share it, and
its core, the bytes that all of them have. Blocks are put in the order of the first eight bytes of their core, then of a hash of the core and of one
of all their bytes: range partitions with Spark's sampled splitters, sorted inside, each row compared with its neighbours and a partition's
last with the next one's first. A block with an equal neighbour is repeated as a whole. One whose core alone is met again is cut into smaller blocks, at the same distances from the
sample everywhere, that are sorted in the same way; the last ones are single strings. Blocks whose core is met nowhere else drop out. A place or
string of any frequency is spread over as many partitions as its rows need, and no group of rows is held together.

Equality is that of eight bytes and two hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import free_name, small_batches
from tabulon.sources.shared import materialize, release

LENGTH = 200
LEAD = 32
SEED = 5
#: Strings in a block, level by level after the whole block of a sample, and in the blocks that they are cut from at equal distances; the last are single ones.
BLOCKS = ((43, 0), (7, 43), (1, 0))
#: Bytes of text that a task looks at together.
CHUNK = 1 << 19
#: A sample's strings start at most this many bytes before it.
REACH = LENGTH - LEAD
BLOCK_SCHEMA = pa.schema([("prefix", pa.int64()), ("core", pa.int64()), ("span", pa.int64()), ("h", pa.int64()), ("c", pa.int32()), ("spot", pa.int64())])
BLOCK_TYPE = "prefix bigint, core bigint, span bigint, h bigint, c int, spot bigint"
ORDER = ("prefix", "core", "span", "h", "c", "spot")
#: A row is repeated, or goes on to smaller blocks, or both; at the first (1) or last (2) row of a partition one neighbour is not known yet.
SORTED_TYPE = "h bigint, c int, spot bigint, repeated boolean, further boolean, edge int, block int, prefix bigint, core bigint, span bigint"
_TABLE = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


def _joined(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)
    return mixed ^ mixed >> np.uint64(29)


def lead_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LEAD bytes that start at each place, by doubling."""
    power, span = _TABLE[data], 1
    with np.errstate(over="ignore"):
        while span < LEAD:
            n = max(0, len(power) - span)
            power = _joined(power[:n], power[span : span + n], span)
            span *= 2
    return power


def _wide(leads: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the 4 LEAD bytes from each place on."""
    with np.errstate(over="ignore"):
        halves = [_joined(leads[at + k], leads[at + k + LEAD], LEAD) for k in (0, 2 * LEAD)]
        return _joined(*halves, 2 * LEAD)


def range_hashes(leads: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the bytes of each range of 4 to 12 LEAD bytes: three wide hashes cover it."""
    width = 4 * LEAD
    with np.errstate(over="ignore"):
        outer = _joined(_wide(leads, begin), _wide(leads, end - width), salt)
        middle = _wide(leads, (begin + end - width) // 2) + (end - begin).astype(np.uint64)
        return _joined(outer, middle, salt + 1).view(np.int64)


def prefixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number in their order."""
    first = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return (np.ascontiguousarray(first).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def spot_of(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A sample's place with the distances of its first and last string start, as one number."""
    return at << 16 | (at - low) << 8 | (at - high)


def starts_of(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first start, last start)."""
    at = spot >> 16
    return at, at - (spot >> 8 & 255), at - (spot & 255)


def samples(leads: np.ndarray) -> np.ndarray:
    """For each string start the place of its sample: the least hash in the string, the leftmost of equal ones."""
    width = REACH + 1
    best, at, span = leads, np.arange(len(leads), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        later, earlier = best[step:], best[:-step]
        smaller = later < earlier
        at = np.where(smaller, at[step:], at[:-step])
        best = np.where(smaller, later, earlier)
        span += step
    return at


def _pieces(texts: Iterable[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of CHUNK bytes or so together; a longer text comes in pieces that overlap by a string."""
    pending, size = [], 0
    for document, data in texts:
        for begin in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
            piece = data[begin : begin + CHUNK + LENGTH - 1]
            if pending and size + len(piece) > CHUNK:
                yield pending
                pending, size = [], 0
            pending.append((document, begin, piece))
            size += len(piece)
    if pending:
        yield pending


def _whole_blocks(texts: Iterable[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(prefix, core, span, document, spot) of every sample of the texts."""
    for pieces in _pieces(texts):
        data = np.frombuffer(b"".join(piece for *_, piece in pieces), np.uint8)
        if len(data) < LENGTH:
            continue
        leads = lead_hashes(data)
        at = samples(leads).astype(np.int64)
        lengths = np.array([len(piece) for *_, piece in pieces])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(pieces)), lengths)[: len(at)]
        # A string that goes over the end of its text is none.
        valid = np.arange(len(at)) + LENGTH <= ends[owner]
        new = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]
        first = np.flatnonzero(new & valid)
        if not len(first):
            continue
        # Starts that are valid are those at the front of their text, so a run ends where the next begins, or where they end.
        following = np.r_[np.flatnonzero(new)[1:], len(at)][np.searchsorted(np.flatnonzero(new), first)]
        last = np.minimum(following, ends[owner[first]] - LENGTH + 1) - 1
        place = at[first]
        shift = np.array([begin for _, begin, _ in pieces])[owner[first]] - (ends - lengths)[owner[first]]
        spans = range_hashes(leads, first, last + LENGTH, 3)
        documents = np.array([document for document, *_ in pieces])[owner[first]]
        yield prefixes(data, place), leads[place].view(np.int64), spans, documents, spot_of(place + shift, first + shift, last + shift)


def _smaller_blocks(data: bytes, spots: np.ndarray, size: int, parent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(prefix, core, span, spot) of the blocks of that many strings that the spots are cut into; parent: the size they were cut to before."""
    at, low, high = starts_of(np.sort(spots))
    chunk = at // CHUNK
    for number in np.unique(chunk):
        own = chunk == number
        place, nearest, furthest = at[own], (at - high)[own], (at - low)[own]
        # Distances from the sample are cut at multiples of parent, and those from there at multiples of size.
        base = furthest // parent * parent if parent else np.zeros_like(place)
        counts = (furthest - base) // size - np.maximum(nearest - base, 0) // size + 1
        row = np.repeat(np.arange(len(place)), counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = base[row] + (np.maximum(nearest - base, 0) // size)[row] * size + step * size
        end = begin + size - 1
        if parent:
            end = np.minimum(end, base[row] + parent - 1)
        end = np.minimum(end, REACH)
        offset = max(0, int(place.min()) - REACH)
        part = np.frombuffer(data, np.uint8)[offset : int(place.max()) + LENGTH]
        leads, local = lead_hashes(part), place[row] - offset
        near, far = np.maximum(begin, nearest[row]), np.minimum(end, furthest[row])
        core_begin, core_end = local - begin, local - end + LENGTH
        cores = range_hashes(leads, core_begin, core_end, 5)
        spans = range_hashes(leads, local - far, local - near + LENGTH, 7)
        yield prefixes(part, core_begin), cores, spans, spot_of(place[row], place[row] - far, place[row] - near)


def _compared(batches) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition that are repeated or go on, and its first and last one, by comparing neighbours."""
    held, first = None, True

    def compare(table: pa.RecordBatch, rows: slice, before: bool, after: bool) -> pa.RecordBatch:
        keys = [table.column(i).to_numpy() for i in range(3)]
        core = (keys[0][1:] == keys[0][:-1]) & (keys[1][1:] == keys[1][:-1])
        span = core & (keys[2][1:] == keys[2][:-1])
        sides = [np.r_[False, span], np.r_[span, False], np.r_[False, core], np.r_[core, False]]
        repeated = sides[0] | sides[1]
        further = (sides[2] & ~sides[0]) | (sides[3] & ~sides[1])
        edge = np.zeros(table.num_rows, np.int32)
        edge[0] += 1 * before
        edge[-1] += 2 * after
        kept = np.flatnonzero((repeated | further | (edge > 0))[rows]) + rows.start
        part = table.take(pa.array(kept))
        # Only the edges need their keys any longer.
        keys = [pa.array(k[kept], pa.int64(), mask=edge[kept] == 0) for k in keys]
        columns = [part.column("h"), part.column("c"), part.column("spot"), pa.array(repeated[kept]), pa.array(further[kept]), pa.array(edge[kept]), part.column("block"), *keys]
        return pa.RecordBatch.from_arrays(columns, names=["h", "c", "spot", "repeated", "further", "edge", "block", "prefix", "core", "span"])

    # held: the last two rows so far; the last one waits for the row after it.
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if held is None else pa.concat_batches([held, batch])
        begin = 0 if first else 1
        if table.num_rows - begin > 1:
            yield compare(table, slice(begin, table.num_rows - 1), first, False)
            first = False
            held = table.slice(table.num_rows - 2)
        else:
            held = table
    if held is not None:
        yield compare(held, slice(0 if first else 1, held.num_rows), first, True)


def _sorted_level(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the level, its table): h, c, spot, repeated, further of each block that is repeated or goes on."""
    ordered = blocks.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("block", F.spark_partition_id())
    table = materialize(ordered.mapInArrow(_compared, SORTED_TYPE), "sorted-blocks")
    # Two rows per partition meet here.
    every = Window.orderBy("block", "edge")
    keys = F.struct("prefix", "core", "span")
    edges = table.where("edge > 0").withColumns({"before": F.lag(keys).over(every), "after": F.lead(keys).over(every)})
    none = F.lit(False)

    def with_side(row_has: int, side: str) -> tuple[Column, Column]:
        open_side = F.col("edge").bitwiseAND(row_has) > 0
        core = open_side & (F.col(f"{side}.prefix") == F.col("prefix")) & (F.col(f"{side}.core") == F.col("core"))
        span = core & (F.col(f"{side}.span") == F.col("span"))
        return F.coalesce(span, none), F.coalesce(core & ~span, none)

    (same_before, core_before), (same_after, core_after) = with_side(1, "before"), with_side(2, "after")
    settled = edges.select("h", "c", "spot", (F.col("repeated") | same_before | same_after).alias("repeated"), (F.col("further") | core_before | core_after).alias("further"))
    return table.where("edge = 0").select("h", "c", "spot", "repeated", "further").unionByName(settled), table


def _keyed(df: DataFrame, text: str) -> DataFrame:
    """(h, c, text) of the texts that hold a string: two hashes name a text, so copies of it are one."""
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") >= LENGTH)
    return texts.select(F.xxhash64("text").alias("h"), F.hash("text").alias("c"), "text")


def _shrunk(batch: pa.RecordBatch, at: int) -> tuple[pa.Array, pa.Array]:
    """(compressed bytes, number of bytes) of a column of texts."""
    data = [(value.as_py() or "").encode("utf-8", "surrogatepass") for value in batch.column(at)]
    return pa.array([pa.compress(d, codec="zstd", asbytes=True) for d in data], pa.binary()), pa.array([len(d) for d in data], pa.int64())


def _grown(z: pa.Scalar, n: pa.Scalar) -> bytes:
    return pa.decompress(z.as_py(), decompressed_size=n.as_py(), codec="zstd", asbytes=True) if n.as_py() else b""


def repeated_blocks(df: DataFrame, text: str) -> DataFrame:
    """(h, c, spots): per text with repeated strings, named by two hashes, the blocks whose strings all repeat, as a table."""
    texts = _keyed(df, text)

    def sampled(batches):
        for batch in batches:
            data = ((i, value.as_py().encode("utf-8", "surrogatepass")) for i, value in enumerate(batch.column(2)))
            for prefix, core, span, document, spot in _whole_blocks(data):
                owner = pa.array(document)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (prefix, core, span)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(spot)], schema=BLOCK_SCHEMA)

    def packed(batches):
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_shrunk(batch, 2)], names=["h", "c", "z", "n"])

    def cut_to(size: int, parent: int):
        def cut(batches):
            for batch in batches:
                for h, c, z, n, spots in zip(*(batch.column(i) for i in range(5)), strict=True):
                    for *keys, spot in _smaller_blocks(_grown(z, n), np.array(spots.as_py(), np.int64), size, parent):
                        size_now = len(spot)
                        yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.repeat(h, size_now), pa.repeat(c, size_now), pa.array(spot)], schema=BLOCK_SCHEMA)

        return cut

    # Kept as a table, as a range sort reads its rows twice.
    blocks = materialize(texts.mapInArrow(sampled, BLOCK_TYPE), "sampled-blocks")
    tables, found = [], []
    for size, parent in BLOCKS:
        rows, table = _sorted_level(blocks)
        release(blocks)
        tables.append(table)
        found.append(rows.where("repeated").select("h", "c", "spot"))
        further = materialize(rows.where("further").groupBy("h", "c").agg(F.collect_set("spot").alias("spots")), "further-blocks")
        moved = texts.mapInArrow(packed, "h bigint, c int, z binary, n bigint").join(further, ["h", "c"]).select("h", "c", "z", "n", "spots")
        blocks = materialize(moved.mapInArrow(_joined_batches(cut_to(size, parent)), BLOCK_TYPE), "smaller-blocks")
        release(further)
    rows, table = _sorted_level(blocks)
    release(blocks)
    found.append(rows.where("repeated").select("h", "c", "spot"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    result = materialize(every.groupBy("h", "c").agg(F.collect_set("spot").alias("spots")), "repeated-blocks")
    release(table, *tables)
    return result


def _joined_batches(rows):
    """The same rows in batches of some thousands."""

    def run(batches):
        pending, size = [], 0
        for batch in rows(batches):
            pending.append(batch)
            size += batch.num_rows
            if size >= 1 << 15:
                yield pa.concat_batches(pending)
                pending, size = [], 0
        if pending:
            yield pa.concat_batches(pending)

    return run


def merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes of the strings that start from low to high."""
    out: list[list[int]] = []
    for begin, end in sorted(zip(low.tolist(), (high + LENGTH).tolist())):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans and kept, the bytes that remain; columns of those names are replaced, all others stay.

    Each byte that a repeated string of LENGTH bytes covers goes, judged on the input. Null texts are empty and stay null, short texts
    stay whole, a string within one document counts, equal rows repeat each other; ids, which may be of any type, are not used; an empty table gives
    no rows. A text of any length is looked at in chunks, except where it is cut, which takes twice its bytes. Texts are
    compressed before they are moved: once for each level of smaller blocks and once to be cut.
    """
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())]

    def facts(whole: bytes, runs: int, kept: bytes) -> tuple:
        return len(whole), len(whole) - len(kept), runs, kept

    return _cut(df.drop(*[name for name, _ in added]), text, lambda whole, runs, kept: whole, facts, added)


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with what remove_repeats keeps of their text in its place, less the bytes of code points that a cut has split; null texts stay null."""
    return _cut(df, text, lambda whole, runs, kept: kept if runs else whole, lambda *_: (), [])


def _cut(rows: DataFrame, text: str, text_of, facts_of, added: list[tuple]) -> DataFrame:
    """The rows with text_of and facts_of of (bytes of the text, number of removed runs, bytes that remain)."""
    spots = repeated_blocks(rows, text)
    taken = [*rows.columns, *[name for name, _ in added]]
    h, c, z, n, found, null = (free_name(taken, name) for name in ("h", "c", "z", "n", "spots", "null"))
    others = [f for f in rows.schema.fields if f.name != text]
    filled = F.coalesce(F.col(text), F.lit(""))
    keyed = rows.select(*[f.name for f in others], F.xxhash64(filled).alias(h), F.hash(filled).alias(c), F.col(text).isNull().alias(null), filled.alias(text))

    def packed(batches):
        for batch in small_batches(batches):
            at = batch.schema.get_field_index(text)
            small, size = _shrunk(batch, at)
            yield batch.remove_column(at).append_column(z, small).append_column(n, size)

    field = T.StructField
    small_schema = T.StructType([*others, field(h, T.LongType()), field(c, T.IntegerType()), field(null, T.BooleanType()), field(z, T.BinaryType()), field(n, T.LongType())])
    listed = spots.select(F.col("h").alias(f"{h}2"), F.col("c").alias(f"{c}2"), F.col("spots").alias(found))
    same = (F.col(h) == F.col(f"{h}2")) & (F.col(c) == F.col(f"{c}2"))
    joined = keyed.mapInArrow(packed, small_schema).join(listed, same, "left").drop(h, c, f"{h}2", f"{c}2")
    kinds = [pa.binary() if isinstance(kind, T.BinaryType) else pa.int64() for _, kind in added]
    names = [*rows.columns, *[name for name, _ in added]]

    def cut(batches):
        for batch in small_batches(batches):
            columns = [batch.column(batch.schema.get_field_index(name)) for name in (z, n, null, found)]
            texts, facts = [], []
            for data, size, empty, places in zip(*columns, strict=True):
                whole, at, parts = _grown(data, size), 0, []
                runs = merged(*starts_of(np.array(places.as_py(), np.int64))[1:]) if places.is_valid else []
                for begin, end in runs:
                    parts.append(whole[at:begin])
                    at = end
                kept = b"".join([*parts, whole[at:]]) if runs else whole
                texts.append(None if empty.as_py() else text_of(whole, len(runs), kept).decode("utf-8", "ignore"))
                facts.append(facts_of(whole, len(runs), kept))
            rest = batch.drop_columns([z, n, null, found])
            arrays = {name: rest.column(i) for i, name in enumerate(rest.schema.names)} | {text: pa.array(texts, pa.string())}
            arrays |= {name: pa.array(values, kind) for (name, _), values, kind in zip(added, zip(*facts), kinds)}
            yield pa.RecordBatch.from_arrays([arrays[name] for name in names], names=names)

    schema = T.StructType([*[field(f.name, T.StringType() if f.name == text else f.dataType) for f in rows.schema.fields], *[field(name, kind) for name, kind in added]])
    return joined.mapInArrow(cut, schema)
