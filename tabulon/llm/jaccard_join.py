"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts with the same words are one class, of which one text is compared. Its MinHash values make TREES labels of DEPTH values, a byte each. The labels of each tree are
put in order, as the leaves of a prefix trie: range partitions sorted inside, each label compared with the next, also across partitions. Neighbours are
candidates if they share a prefix; the prefix is shortened from DEPTH values on until a pair at the threshold shares one in some tree with the target recall.
Candidates are held together as groups. A group that goes over one tile is parted once more by a filter that loses no link: two texts at the threshold share
one of the shingles that each has to have among its rarest (in the group) fifth and one more; so pages that share no more than boilerplate part again, however many they are. In what
is left, tiles of bounded size are compared with each other: all pairs whose sizes allow the threshold are counted by their exact shingle sets, and no pair is emitted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import BYTES_AT_ONCE, free_name, small_batches, word_list
from tabulon.llm.components import components
from tabulon.sources.shared import materialize, release, small_arrow_batches

WORDS = 5
THRESHOLD = 0.8
#: With 64 trees this is reached at a prefix of 6 values.
TARGET_RECALL = 1 - 1e-8
TREES = 64
DEPTH = 7
#: Texts, and shingles of them, that a tile holds about; a longer text is a tile of its own.
TILE = 256
TILE_SHINGLES = 1 << 18
SEED = 11
#: Shingles that are compared at once.
COLUMNS = 4096


def prefix_length(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that a pair at the threshold shares in one of the trees with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingle_hashes(words: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) | zlib.adler32(w.encode("utf-8", "surrogatepass")) << 32 for w in words], np.uint64)
    width = min(WORDS, len(codes))
    mixed = np.zeros(len(codes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            mixed = (mixed ^ codes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed + np.uint64(width))


def labels(hashes: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """One number per tree, in whose order texts with the same first values are neighbours: a byte of each MinHash value, the first one on top."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    shifts = draw.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    # Values of 32 bits are enough for the least of a text; candidates are compared by their sets.
    short = (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(trees * depth, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for begin in range(0, len(short), 128):
            part = short[begin : begin + 128, None] * factors
            part ^= part >> np.uint32(15)
            part *= shifts
            least = np.minimum(least, part.min(0))
        # The least values are small numbers, so their bytes are mixed.
        mixed = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    packed = np.zeros((trees, 8), np.uint8)
    packed[:, :depth] = mixed.reshape(trees, depth)
    return (packed.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _words(text: str | None) -> list[str]:
    for space in "\t\n\x0b\x0c\r":
        text = (text or "").replace(space, " ")
    return [w for w in text.split(" ") if w]


def _signed(docs: DataFrame) -> DataFrame:
    """(doc, id, n, labels) of (doc, id, text): the number of shingles and the labels, none for a text without words."""
    kind, doc_type = _doc_types(docs)

    def rows(batches):
        for batch in small_batches(batches):
            sets = [shingle_hashes(_words(value.as_py())) for value in batch.column(2)]
            found = [labels(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc", "id", "n", "labels"]
            )

    return docs.select("doc", "id", "text").mapInArrow(rows, f"doc {kind}, id bigint, n bigint, labels array<bigint>")


def _doc_types(docs: DataFrame) -> tuple[str, pa.DataType]:
    return ("string", pa.string()) if docs.schema["doc"].dataType.typeName() == "string" else ("bigint", pa.int64())


def _with_sets(texts: DataFrame) -> DataFrame:
    """The rows with the sorted shingle hashes of text in its place."""

    def rows(batches):
        for batch in small_batches(batches):
            at = batch.schema.get_field_index("text")
            sets = [shingle_hashes(_words(value.as_py())).tobytes() for value in batch.column(at)]
            yield batch.drop_columns(["text"]).append_column("shingles", pa.array(sets, pa.binary()))

    fields = [f for f in texts.schema.fields if f.name != "text"]
    return texts.mapInArrow(rows, T.StructType([*fields, T.StructField("shingles", T.BinaryType())]))


LEAF_ROW = "a bigint, b bigint, edge int, block int, tree int, label bigint"


def forest_edges(per_text: DataFrame, length: int) -> DataFrame:
    """(a, b): texts of a sorted trie that share a prefix of that many values. Those of a partition's batch that share it are linked to the least of them, and
    batches and partitions by one of each, so the edges hold together all that share it and are mostly the same in all trees."""
    leaves = per_text.select("id", F.posexplode("labels").alias("tree", "label"))
    order = ["tree", "label", "id"]
    ordered = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    rest = 8 * (8 - length)

    def neighbours(batches):
        """The links of a partition, its first leaf (1), and one that stands for its last ones (2)."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, trees, values, block = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "tree", "label", "block"))
            if held is None:
                yield _leaf(ids[0], 1, block[0], trees[0], values[0])
            else:
                ids, trees, values = (np.r_[h, x] for h, x in zip(held, (ids, trees, values)))
            same = (trees[1:] == trees[:-1]) & ((values[1:] ^ values[:-1]).view(np.uint64) >> np.uint64(rest) == 0)
            begins = np.flatnonzero(np.r_[True, ~same])
            least = np.repeat(np.minimum.reduceat(ids, begins), np.diff(np.r_[begins, len(ids)]))
            at = np.flatnonzero(ids != least)
            none = pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(least[at]), pa.array(np.zeros(len(at), np.int32)), none, none, pa.nulls(len(at), pa.int64())], names=["a", "b", "edge", "block", "tree", "label"]
            )
            held, last = (least[-1:], trees[-1:], values[-1:]), block[-1]
        if held is not None:
            yield _leaf(held[0][0], 2, last, held[1][0], held[2][0])

    found = materialize(ordered.mapInArrow(neighbours, LEAF_ROW), "forest-neighbours")
    # Two leaves per partition meet here.
    after = F.lead(F.struct("a", "tree", "label")).over(Window.orderBy("block", "edge"))
    ends = found.where("edge > 0").withColumn("after", after).where("edge = 2 and after.tree = tree")
    shared = F.shiftrightunsigned(F.col("label").bitwiseXOR(F.col("after.label")), rest) == 0
    across = ends.where(shared & (F.col("after.a") != F.col("a"))).select("a", F.col("after.a").alias("b"))
    return found.where("edge = 0").select("a", "b").unionByName(across).distinct()


def _leaf(key, edge: int, block, tree, label) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((int(key), None, edge, int(block), int(tree), int(label)), kinds)], names=["a", "b", "edge", "block", "tree", "label"])


def parted(members: DataFrame) -> DataFrame:
    """(id, root) of (root, id, shingles): groups of texts that may have links, those without dropped out.

    With a and b shingles and a similarity of t, two texts share at least t max(a, b) of them, so each has one of the shared ones among any a - ceil(t a) + 1
    of its own that come first in an order that all texts follow. Here the shingles that fewest texts of the group have come first.
    """

    def exploded(batches):
        for batch in small_batches(batches):
            sets = [np.frombuffer(value.as_py(), np.int64) for value in batch.column(2)]
            owner = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["root", "id", "shingle"])

    rows = materialize(members.select("root", "id", "shingles").mapInArrow(exploded, "root bigint, id bigint, shingle bigint"), "group-shingles")
    counts = materialize(rows.groupBy("root", "shingle").agg(F.count(F.lit(1)).alias("df")), "shingle-counts")
    known = rows.join(counts, ["root", "shingle"])
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("id").orderBy("df", "shingle")
    needed = F.col("n") - F.ceil(F.col("n") * round(THRESHOLD * 10) / 10) + 1
    first = known.withColumn("place", F.row_number().over(ordered)).join(sizes, "id").where((F.col("place") <= needed) & (F.col("df") > 1)).select("root", "shingle", "id")
    first = materialize(first, "first-shingles")
    # A table too, so that the texts of a frequent shingle may be joined by several tasks.
    stars = materialize(first.groupBy("root", "shingle").agg(F.min("id").alias("b")), "shingle-stars")
    edges = first.join(stars, ["root", "shingle"]).where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b").distinct()
    found = materialize(components(edges), "parted-groups")
    release(rows, counts, first, stars)
    return found


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair shares; exact, and bounded by the tile whatever the texts are."""
    counts = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return counts
    values = [np.concatenate(side) for side in (left, right)]
    owners = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    common = np.intersect1d(*values)
    places = []
    for value, owner in zip(values, owners):
        at = np.minimum(np.searchsorted(common, value), max(len(common) - 1, 0))
        known = common[at] == value if len(common) else np.zeros(len(value), bool)
        order = np.argsort(at[known], kind="stable")
        places.append((at[known][order], owner[known][order]))
    for begin in range(0, len(common), COLUMNS):
        # 0 and 1 in float32 are summed exactly: a product has at most COLUMNS terms.
        sides = []
        for (at, owner), side in zip(places, (left, right)):
            span = slice(*np.searchsorted(at, [begin, begin + COLUMNS]))
            sides.append(np.zeros((len(side), COLUMNS), np.float32))
            sides[-1][owner[span], at[span] - begin] = 1
        counts += (sides[0] @ sides[1].T).astype(np.int64)
    return counts


def _compare(rows: list[dict], first: int, second: int) -> list[tuple]:
    """The links of one pair of tiles: per text (id, their number, their documents, the least text that links join it to)."""
    by_id = {r["id"]: r for r in rows}
    parts = [[by_id[i] for i in sorted(by_id) if by_id[i]["tile"] == t] for t in (first, second)]
    sets = [[np.frombuffer(r["shingles"], np.uint64) for r in p] for p in parts]
    sizes = [np.array([len(s) for s in side], np.int64) for side in sets]
    low, high = np.minimum(sizes[0][:, None], sizes[1][None, :]), np.maximum(sizes[0][:, None], sizes[1][None, :])
    wanted = low * 10 >= high * round(THRESHOLD * 10)
    if first == second:
        wanted &= np.triu(np.ones(wanted.shape, bool), 1)
    shared = shared_counts(sets[0], sets[1]) if wanted.any() else np.zeros(wanted.shape, np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    linked = wanted & (shared * 10 >= union * round(THRESHOLD * 10))
    ids, copies = ([np.array([r[c] for r in p], np.int64) for p in parts] for c in ("id", "copies"))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in zip(*np.nonzero(linked)):
        a, b = find(int(ids[0][i])), find(int(ids[1][j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
    out = []
    for side, axis in ((0, 1), (1, 0)):
        n = linked.sum(axis)
        documents = linked @ copies[1] if side == 0 else copies[0] @ linked
        out += [(int(ids[side][i]), int(n[i]), int(documents[i]), find(int(ids[side][i]))) for i in np.flatnonzero(n)]
    return out


LINKS = pa.schema([("id", pa.int64()), ("n_texts", pa.int64()), ("n_documents", pa.int64()), ("root", pa.int64())])


def _compared(batches):
    """Pairs of tiles one after the other: the rows of one are next to each other."""
    key, rows = None, []

    def links():
        found = _compare(rows, key[1], key[2])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), LINKS.types)], schema=LINKS) if found else None

    for batch in batches:
        names = batch.schema.names
        for values in zip(*batch.columns, strict=True):
            row = {name: value.as_py() for name, value in zip(names, values)}
            now = (row["root"], row["tile_a"], row["tile_b"])
            if rows and now != key and (found := links()) is not None:
                yield found
            if now != key:
                key, rows = now, []
            rows.append(row)
    if rows and (found := links()) is not None:
        yield found


def words_hash(text: Column) -> Column:
    """A number that all texts with the same words share."""
    return F.xxhash64(F.sha2(F.array_join(word_list(text), " ").cast("binary"), 256))


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, id, text): id is the hash of the words."""
    doc = F.col(doc_id) if df.schema[doc_id].dataType.typeName() == "string" else F.col(doc_id).cast("bigint")
    return df.select(doc.alias("doc"), words_hash(F.col(text)).alias("id"), F.col(text).alias("text"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, id) of every row, and one row per distinct text: id, doc, copies, root, n_text_links, n_others."""
    # All that runs Python is written inside.
    with small_arrow_batches(docs.sparkSession, BYTES_AT_ONCE):
        return _joined_classes(docs)


def _joined_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    signed = materialize(_signed(docs), "signatures")
    known = signed.select("doc", "id")
    firsts = [F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels")]
    per_text = materialize(signed.groupBy("id").agg(*firsts), "distinct-texts")
    edges = materialize(forest_edges(per_text, prefix_length()), "forest-edges")
    groups = materialize(components(edges), "candidate-groups")
    release(edges)

    # Texts of the groups: a text is found by its words and, as its copies differ in spaces only, by one of its documents.
    facts = per_text.select("id", "doc", "copies", "n")
    chosen = facts.join(groups, "id").withColumnsRenamed({"doc": "of_doc"})
    same = (docs["id"] == chosen["id"]) & docs["doc"].eqNullSafe(chosen["of_doc"])
    sets = materialize(_with_sets(docs.join(chosen, same).select(docs["id"], "text", "copies", "n", "root")).dropDuplicates(["id"]), "group-texts")
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    sizes = materialize(sizes.withColumn("tiles", _tiles()), "group-sizes")
    large = sets.join(sizes.where("tiles > 1").select("root"), "root", "left_semi")
    smaller = parted(large)
    again = sets.drop("root").join(smaller, "id")
    new_sizes = materialize(again.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles")).withColumn("tiles", _tiles()), "part-sizes")
    small = sets.join(sizes.where("tiles = 1").select("root", "tiles"), "root")
    tiled = small.unionByName(again.join(new_sizes.select("root", "tiles"), "root"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles").cast("bigint")).cast("int"))
    # Each text goes to the pairs of tiles it is part of: as many as its group has tiles.
    spread = tiled.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.withColumns({"tile_a": F.least("tile", "partner"), "tile_b": F.greatest("tile", "partner")})
    pairs = ["root", "tile_a", "tile_b"]
    met = spread.select("id", "copies", "shingles", "root", "tile", "tile_a", "tile_b").repartition(*pairs).sortWithinPartitions(*pairs)
    linked = materialize(met.mapInArrow(_compared, "id bigint, n_texts bigint, n_documents bigint, root bigint"), "links")
    release(sets, sizes, new_sizes, smaller, groups)
    counts = materialize(linked.groupBy("id").agg(F.sum("n_texts").alias("n_text_links"), F.sum("n_documents").alias("n_others")), "link-counts")
    joined = materialize(components(linked.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "_root"), "classes")
    rooted = per_text.select("id", "doc", "copies").join(joined, "id", "left").withColumn("root", F.coalesce("_root", "id")).drop("_root")
    found = materialize(rooted.join(counts, "id", "left").na.fill(0, ["n_text_links", "n_others"]), "text-classes")
    release(per_text, linked, counts, joined)
    return known, found


def _tiles() -> Column:
    return F.ceil(F.greatest(F.col("texts") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, n_copies) per row.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more (a shorter
    text is one shingle; texts without words equal each other and nothing else). class_id is the least id of the documents
    joined by links, n_links the number of linked documents, n_text_links of linked other texts, n_copies of documents with
    the same words, itself included. A null id is counted like any other, and class_id is null only where all ids of a class
    are; ids may be whole numbers or text; equal rows count each; other columns are left out; an empty table gives no rows. Labels and ids of all documents are
    shuffled, texts only where there are candidates, and of copies one. A text of any length is one set of hashes in its task, eight bytes a word.
    """
    known, facts = _classes(_keyed(df, doc_id, text))
    # Tables on both sides, so that the rows of a large class may be joined by several tasks.
    named = materialize(facts.groupBy("root").agg(F.min("doc").alias("class_id")), "class-ids")
    classes = materialize(facts.drop("doc").join(named, "root"), "named-texts")
    return known.join(classes, "id").select(
        F.col("doc").alias("doc_id"),
        "class_id",
        (F.col("n_others") + F.col("copies") - 1).alias("n_links"),
        "n_text_links",
        F.col("copies").alias("n_copies"),
    )


def one_per_class(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stand for their class: the document with the least id, null ids last.

    Different texts may share an id, or have none: a row is known by its id and its words, so each class keeps one row whatever its
    ids are. Of equal ids in a class the least hash of the words stays, and of rows equal in both, one.
    """
    keyed = _keyed(df, doc_id, text)
    _, facts = _classes(keyed)
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id")).alias("first")
    kept_doc, kept_words, words = (free_name(df.columns, n) for n in ("kept_doc", "kept_words", "words"))
    kept = materialize(facts.groupBy("root").agg(first).select(F.col("first.doc").alias(kept_doc), F.col("first.id").alias(kept_words)), "kept-texts")
    rows = df.withColumn(words, words_hash(F.col(text)))
    doc = F.col(doc_id) if df.schema[doc_id].dataType.typeName() == "string" else F.col(doc_id).cast("bigint")
    same = doc.eqNullSafe(F.col(kept_doc)) & (F.col(words) == F.col(kept_words))
    return rows.join(kept, same, "left_semi").dropDuplicates([doc_id, words]).drop(words)
