"""Periodic runs of words, found by seeds that are extended along diagonals.

A run is a maximal stretch of words with smallest period q and at least max(SHORTEST, 2 q) words. On the diagonal of lag q it is
a stretch of equal pairs of words, max(SHORTEST - q, q) of them at least: its guaranteed overlap. Lags are taken in classes [L, 2L); half the
overlap that the class guarantees is the length k of its grams, so that each stretch holds a gram that starts at a multiple of k. The k-grams of a
batch of texts are indexed by their hash and place, the later occurrences of each such gram within the class's lags are
the seeds, and a seed is extended in both directions word by word unless the table of its lag says that the words up to there are covered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import free_name, word_list

# The least number of words and of periods in a run.
SHORTEST = 12
PERIODS = 2
#: Words of whole texts that are searched together; a longer text is searched alone.
WORDS_AT_ONCE = 1 << 16
#: Steps of an extension that are compared at first; each further one takes twice as many.
FIRST_STEP = 16
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def overlap(lag: int) -> int:
    """Pairs of equal words that a run of this period has at least."""
    return max(SHORTEST - lag, (PERIODS - 1) * lag)


def lag_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least lag, lag above the last, gram length) of the classes that a text of so many words needs."""
    low = 1
    while PERIODS * low <= longest:
        high = 2 * low
        guaranteed = min(overlap(lag) for lag in (low, high - 1, SHORTEST // 2) if low <= lag < high)
        yield low, high, (guaranteed + 1) // 2
        low = high


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ mixed >> np.uint64(31)


def gram_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A number for the width words from each place on; equal grams have equal numbers."""
    power, out, done, span = codes.astype(np.uint64), None, 0, 1
    with np.errstate(over="ignore"):
        while span <= width:
            if width & span:
                n = len(codes) - done - span + 1
                out = power[:n] if out is None else _joined(out[:n], power[done : done + n])
                done += span
            span *= 2
            n = len(codes) - span + 1
            if n <= 0 or span > width:
                break
            power = _joined(power[:n], power[span // 2 : span // 2 + n])
    return out


def seeds(codes: np.ndarray, room: np.ndarray, low: int, high: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of equal grams of the same text, by lag and place; places are multiples of width.

    room is the number of words from each place to the end of its text.
    """
    anchors = np.arange(0, len(codes) - width + 1, width)
    anchors = anchors[room[anchors] >= low + width]
    none = np.zeros(0, np.int64)
    if not len(anchors):
        return none, none
    hashes = gram_hashes(codes, width)
    order = np.argsort(hashes, kind="stable")
    ranks = np.empty(len(hashes), np.int64)
    ordered = hashes[order]
    ranks[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
    # The index: grams by rank, places of a gram in order.
    stride = len(hashes) + 1
    index = ranks[order] * stride + order
    base = ranks[anchors] * stride
    # Lags of a gram that would end outside the text are cut off.
    last = np.minimum(high, room[anchors] - width + 1)
    begin = np.searchsorted(index, base + np.minimum(anchors + low, stride - 1))
    end = np.searchsorted(index, base + np.minimum(anchors + last, stride - 1))
    counts = np.maximum(end - begin, 0)
    if not counts.any():
        return none, none
    places = np.repeat(anchors, counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    lags = order[at] - places
    by_lag = np.lexsort((places, lags))
    return places[by_lag], lags[by_lag]


def _equal_ahead(codes: np.ndarray, a: int, b: int, limit: int) -> int:
    """How many words from a and from b on are equal, up to limit."""
    done, step = 0, FIRST_STEP
    while done < limit:
        n = min(step, limit - done)
        differ = codes[a + done : a + done + n] != codes[b + done : b + done + n]
        if differ.any():
            return done + int(differ.argmax())
        done += n
        step *= 2
    return limit


def runs_of(codes: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of the texts that codes holds end to end, by start and period."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    found: list[dict[tuple[int, int], int]] = [{} for _ in lengths]
    longest = int(lengths.max(initial=0))
    if longest < SHORTEST:
        return [[] for _ in lengths]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    room = ends[owner] - np.arange(len(codes))
    backward = codes[::-1]
    total = len(codes)
    # For each place the end and the period of the run that covers it and reaches furthest.
    reach, period_at = np.zeros(total, np.int64), np.ones(total, np.int64)
    for low, high, width in lag_classes(longest):
        places, lags = seeds(codes, room, low, high, width)
        # Words inside a known run whose period divides the lag have no other run on that diagonal.
        new = (reach[places] < places + lags + width) | (lags % period_at[places] != 0)
        places, lags = places[new], lags[new]
        if not len(places):
            continue
        lag_now, covered = 0, 0
        for place, lag in zip(places.tolist(), lags.tolist()):
            if lag != lag_now:
                lag_now, covered = lag, -1
            if place < covered or (reach[place] >= place + lag + width and lag % period_at[place] == 0):
                continue
            text = int(owner[place])
            begin, end = int(starts[text]), int(ends[text])
            ahead = _equal_ahead(codes, place, place + lag, end - place - lag)
            behind = _equal_ahead(backward, total - place, total - place - lag, place - begin)
            covered = place + ahead
            first, size = place - behind, ahead + behind + lag
            if ahead + behind < overlap(lag):
                continue
            key = (first - begin, size)
            # Lags rise, so a stretch that is there already has a smaller period, which divides this lag.
            if key not in found[text]:
                found[text][key] = lag
                part = slice(first, first + size)
                further = reach[part] < first + size
                reach[part] = np.where(further, first + size, reach[part])
                period_at[part] = np.where(further, lag, period_at[part])
    return [sorted(((s, n, q) for (s, n), q in of_text.items()), key=lambda r: (r[0], r[2])) for of_text in found]


def kept_words(n: int, runs: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those of no run, or of the first period of each run that holds them."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def _searched(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64)
    lengths = np.array([len(words) for words in texts], np.int64)
    for words, runs in zip(texts, runs_of(codes, lengths), strict=True):
        if runs:
            keep = kept_words(len(words), runs)
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        yield runs, b" ".join(words)


def find_runs(df: DataFrame, text: str, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The rows with their runs, by start and period, and the text without their repetitions; columns of those names are replaced.

    Words are what spaces, tabs and line ends of ASCII separate, numbered from 0. Null and empty texts have no runs and an empty
    collapsed text; equal rows each have theirs; an empty table gives none. A word goes if any run holds it after that
    run's first period. Texts are searched whole where they are read, short ones together; a text needs some 200 bytes of memory a word,
    and time in proportion to its length times the logarithm of it, besides its stretches. No shuffle.
    """
    rows = df.drop(runs, collapsed)
    whole = free_name(df.columns, "text")

    def searched(batches):
        for batch in batches:
            at = batch.schema.get_field_index(whole)
            begin, size, pending = 0, 0, []
            for i, value in enumerate(batch.column(at)):
                # Splitting bytes parts them at ASCII spaces only.
                pending.append((value.as_py() or "").encode("utf-8", "surrogatepass").split())
                size += len(pending[-1])
                if size >= WORDS_AT_ONCE or i + 1 == batch.num_rows:
                    found = list(_searched(pending))
                    part = batch.slice(begin, len(pending)).drop_columns([whole])
                    listed = [[{"start": s, "length": n, "period": q} for s, n, q in of_text] for of_text, _ in found]
                    part = part.append_column(runs, pa.array(listed, RUNS))
                    yield part.append_column(collapsed, pa.array([words.decode("utf-8", "surrogatepass") for _, words in found], pa.string()))
                    begin, size, pending = i + 1, 0, []

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"`{runs}` {RUN}, `{collapsed}` string").fields])
    return df.select(*rows.columns, F.col(text).alias(whole)).mapInArrow(searched, schema)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, in which each id with crc32 % 10 = 0 repeats words from some word on.

    With g the tenth of the crc32 of the decimal id and n words, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). A text with a null id or without words stays as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = word_list(text)
    n = F.size(words)
    g = F.floor(h / 10).cast("bigint")
    a = F.pmod(g, n.cast("bigint"))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    from_a = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(from_a, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


def summary(found: DataFrame, doc_id: str = "doc_id", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what find_runs gives."""
    key = F.transform(F.col(runs), lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    lines = F.transform(F.col(runs), lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    measured = found.select(F.col(doc_id).alias("doc_id"), F.col(runs).alias("runs"), F.array_min(key).alias("best"), text.alias("lines"), F.col(collapsed).alias("collapsed"))
    return measured.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
