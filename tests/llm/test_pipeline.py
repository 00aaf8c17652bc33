"""The whole run of the pipeline against plain Python over the documents of the smallest scale."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tabulon.llm import classifier
from tabulon.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def words(text):
    for space in "\t\n\x0b\x0c\r":
        text = (text or "").replace(space, " ")
    return [w for w in text.split(" ") if w]


def one_per_class(texts):
    """The least id of each group that links of 0.8 or more hold together."""
    sets = {}
    for doc_id, text in texts.items():
        found = words(text)
        sets[doc_id] = frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))
    root = {doc_id: doc_id for doc_id in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {doc_id: texts[doc_id] for doc_id in ids if root[doc_id] == doc_id}


def without_repeats(texts):
    data = {doc_id: (text or "").encode() for doc_id, text in texts.items()}
    counts = Counter(b[p : p + 200] for b in data.values() for p in range(len(b) - 199))
    out = {}
    for doc_id, b in data.items():
        covered = bytearray(len(b))
        for p in range(len(b) - 199):
            if counts[b[p : p + 200]] > 1:
                covered[p : p + 200] = b"\1" * 200
        out[doc_id] = bytes(x for x, c in zip(b, covered) if not c).decode("utf-8", "ignore")
    return out


def mixed(texts, sources):
    sizes = {doc_id: len(words(text)) for doc_id, text in texts.items()}
    totals = Counter()
    for doc_id, n in sizes.items():
        totals[sources[doc_id]] += n
    names = sorted(totals, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, open_names, target = sum(totals.values()) * 15 / 10.0, set(names), {}
    while open_names:
        level = budget / sum(weight[s] for s in open_names)
        full = {s for s in open_names if 2 * totals[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_names}
            break
        target |= {s: float(2 * totals[s]) for s in full}
        budget -= sum(2 * totals[s] for s in full)
        open_names -= full
    by_source, packets = defaultdict(list), []
    for doc_id, text in texts.items():
        key = int(hashlib.md5(f"mix-1:{doc_id}:{text or ''}".encode()).hexdigest()[:15], 16)
        by_source[sources[doc_id]].append((key, doc_id))
    for s, docs in by_source.items():
        served = 0
        for copy in range(2):
            for key, doc_id in sorted(docs):
                for packet in range(-(-sizes[doc_id] // 64)):
                    n = min(64, sizes[doc_id] - 64 * packet)
                    served += n
                    packets.append((served / target[s], s is None, s or "", copy, key, doc_id, packet, n))
    left, taken = math.floor(sum(totals.values()) * 15 / 10), Counter()
    for _, _, _, copy, _, doc_id, _, n in sorted(packets):
        taken[doc_id, copy] += min(n, left)
        left -= min(n, left)
    for (doc_id, _), n in taken.items():
        if n:
            yield doc_id, texts[doc_id] if n == sizes[doc_id] else " ".join(words(texts[doc_id])[:n])


def packed(copies):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in copies:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        start = 0
        while start < len(ids):
            length = next(1 << k for k in range(11, -1, -1) if 1 << k <= len(ids) - start)
            yield doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)
            start += length


def test_run_equals_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    scored = classifier.score(docs, classifier.fit(docs, table(spark, FOLDER, "labels"))).collect()
    sources = {r.doc_id: r.source for r in scored}
    kept = {r.doc_id: r.text for r in scored if r.score >= classifier.THRESHOLD}
    assert 0 < len(kept) < len(scored)
    expected = Counter(packed(mixed(without_repeats(one_per_class(kept)), sources)))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}


def test_stages_on_empty_tables_and_odd_rows(spark, tmp_path):
    """No rows, nulls in every column, empty and repeated texts, one row: each stage gives the columns of its input."""
    docs = table(spark, FOLDER, "documents")
    labels = table(spark, FOLDER, "labels")
    odd = [(None, None, None, None, None), (1, None, "en", "a", None), (2, "", None, "a", 0), (2, "", None, "a", 0), (3, "word", "en", None, 4), (None, "x " * 300, "en", "b", 600)]
    for name, rows, marks in (("none", [], labels), ("odd", odd * 2, labels.limit(0)), ("one", odd[4:5], labels)):
        folder = str(tmp_path / name)
        marks.write.parquet(f"{folder}/labels.parquet")
        kept = spark.createDataFrame(rows, docs.schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, folder)
            assert out.columns == docs.columns or stage is corpus_pipeline.sequences
            if stage is corpus_pipeline.sequences:
                out = out.select("doc_id", "doc_tokens")
            before, kept = kept, spark.createDataFrame(out.collect(), out.schema)
            assert kept.count() <= 2 * before.count() and (kept.count() > 0 or name == "none" or stage is not corpus_pipeline.quality)
