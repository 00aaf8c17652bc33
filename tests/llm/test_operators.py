"""The operators against brute force on small literal tables, with nulls, ties, repeated rows and hot groups."""

from __future__ import annotations

import hashlib
import importlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import classifier, fingerprints, jaccard_join, license_scan, mixing, packing, quality_rules, suffix_dedup, token_counts, url_filter
from tabulon.llm.components import components
from tabulon.llm.encoding import default_vocabulary, encode
from tabulon.llm.url_filter import UrlRule

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int, path string"


def sentence(draw, n):
    return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    base, passage = sentence(draw, 90), sentence(draw, 60)
    near = [base.replace(base.split()[i], "zzz", 1) for i in range(5)]
    texts = [None, "", " \n\t ", "one two", base, base, *near, passage, sentence(draw, 40) + "\n" + passage + " " + sentence(draw, 30)]
    texts += [sentence(draw, draw.randint(1, 120)) for _ in range(20)] + [sentence(draw, 6000), "ab" * 400, "Licensed under the MIT License."]
    texts += ["hot line " + sentence(draw, 12)] * 20
    out = [(i, t, "en", None if i % 7 == 0 else f"s{min(i % 5, 2)}", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return out + [out[9], out[9]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_urls(spark):
    rules = [UrlRule("block", "net", "/"), UrlRule("allow", "a.net", "/x"), UrlRule("block", "a.net", "/x/y"), UrlRule("allow", "c.a.net", "/"), UrlRule("block", "a.net", "/x/z")]
    urls = [None, "", "a.net/x", "http://A.net/x/y?q", "http://b.a.net/x", "http://b.a.net/x/y/1#f", "http://c.a.net/x/y", "http://xa.net", "http://xa.net/", "http://net/", "http://anet/x", "http://a.net/x/z"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 3)], "page_id int, url string, host string").repartition(4)

    def expected(url):
        if not url or "://" not in url:
            return None
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, _, path = rest.partition("/")
        host, path = host.lower(), "/" + path if "/" in rest else ""
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: (len(r.host + r.path), len(r.host))) if fits else None

    for row in url_filter.filter_urls(df, "url", rules).collect():
        rule = expected(row.url)
        assert (row.rule, row.verdict) == ((rule.host + rule.path, rule.verdict) if rule else (None, "allow")), row
    assert url_filter.filter_urls(df.limit(0), "url", rules).count() == 0
    assert url_filter.filter_urls(df, "url", []).where("verdict = 'allow'").count() == len(urls) * 3


def test_quality(docs, rows, empty):
    found = quality_rules.apply_rules(docs, "text")
    by_id = {r.doc_id: r for r in found.collect()}
    for doc_id, text, *_ in rows:
        words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        row = by_id[doc_id]
        assert (row.n_words, row.n_repeat_words, row.word_chars) == (len(words), len(covered), sum(map(len, words)))
    assert found.count() == len(rows) and quality_rules.apply_rules(empty, "text").count() == 0
    # The input brings one exchange of its own.
    assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1


def test_mix(docs, rows, empty, spark):
    mixed = mixing.mix(docs, "doc_id", "source", "text").collect()
    sizes = Counter()
    for r in mixed:
        sizes[r.row] = r.size
    budget = sum(sizes.values()) * 15 // 10
    assert all(0 <= r.taken <= r.size for r in mixed) and len(mixed) == 2 * len(rows)
    assert sum(r.taken for r in mixed) == budget
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.PACKET
        # A copy is taken before the next one begins.
        served = [r.taken < r.size for r in sorted(own, key=lambda r: (r.copy, r.finish)) if r.size]
        assert served == sorted(served)
    assert mixing.mix(empty, "doc_id", "source", "text").count() == 0
    again = mixing.mix(docs.repartition(3), "doc_id", "source", "text").collect()
    key = lambda r: (r.doc_id, r.copy, r.size, r.taken)
    assert sorted(map(key, mixed), key=repr) == sorted(map(key, again), key=repr)


def test_the_budget_alone_decides_what_is_taken(docs, rows, monkeypatch):
    found = {}
    for tenths in (15, 6, 1000):
        monkeypatch.setattr(mixing, "BUDGET_TENTHS", tenths)
        aims = mixing.targets(docs.select("source", mixing.word_count(F.col("text")).alias("size")), tenths=15)
        monkeypatch.setattr(mixing, "targets", lambda rows, aims=aims: aims)
        found[tenths] = mixing.mix(docs, "doc_id", "source", "text").collect()
        monkeypatch.undo()
    total = sum(len((r[1] or "").split()) for r in rows)
    # Without the cut every copy is taken whole; a smaller budget takes the earliest packets, in the same proportions.
    assert all(r.taken == r.size for r in found[1000])
    assert [sum(r.taken for r in found[t]) for t in (15, 6)] == [total * 15 // 10, total * 6 // 10]
    least = min(r.finish for r in found[6] if r.taken < r.size)
    for source in {r.source for r in found[6]}:
        own = [r for r in found[6] if r.source == source]
        assert abs(sum(r.taken for r in own) - least * own[0].target) < 8000
    packets = sorted((r.finish, r.taken == r.size) for r in found[6] if 0 < r.size <= mixing.PACKET)
    assert [full for _, full in packets] == sorted((full for _, full in packets), reverse=True)


def test_mixed_documents_come_in_order_and_rerun_alike(spark):
    draw = random.Random(3)
    data = [(draw.choice([None, 1, 2]), sentence(draw, draw.randint(0, 200)), draw.choice(["a", None]), i, "r", 5) for i in range(150)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, size bigint, row string, n_chars bigint")
    first, second = (mixing.mixed_documents(df.repartition(n)).collect() for n in (2, 7))
    assert first == second and first[0].asDict().keys() == set(df.columns)
    assert sum(len(r.text.split()) for r in first) == sum(len(d[1].split()) for d in data) * 15 // 10
    assert all(r.n_chars == len(r.text) for r in first) and mixing.mixed_documents(df.limit(0)).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = Counter()
    pieces = packing.pack(docs, "doc_id", "text").collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    parts: dict = {}
    for p in pieces:
        assert p.length & (p.length - 1) == 0 and p.length <= 2048 and p.offset == 0 and len(p.ids) == 4 * p.length
        parts.setdefault((p.doc_id, p.start, p.length), []).append(bytes(p.ids))
    for doc_id, text, *_ in rows:
        whole[doc_id] += 1
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        data = b"".join(parts[k][0] for k in sorted(k for k in parts if k[0] == doc_id))
        assert np.frombuffer(data, "<u4").tolist() == ids
    assert packing.pack(empty, "doc_id", "text").count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "  two  \n\n spaces\t", "日本語 ١٢٣ it's I'LL", "\x00� 🙂"])
def test_same_ids_as_the_tokenizer_file(text):
    from tokenizers import Tokenizer
    import public_tokenizers

    expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert encode(default_vocabulary(), text) == expected


def test_token_counts(docs, rows, empty):
    lengths = [len(encode(default_vocabulary(), r[1])) for r in rows]
    histogram = token_counts.length_histogram(docs, "text").cache()
    for r in histogram.collect():
        assert r.n_docs == lengths.count(r.n_tokens) and r.longer_docs == sum(n > r.n_tokens for n in lengths)
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths) and r.total_tokens == sum(lengths)
    assert token_counts.truncated_total(histogram, 50).first()[0] == sum(min(n, 50) for n in lengths)
    assert token_counts.quantile(histogram, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.length_histogram(empty, "text").count() == 0


def test_jaccard(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    sets = []
    for r in rows:
        words = (r[1] or "").split()
        sets.append((tuple(words), frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))))
    expected = Counter()
    for i, (words, one) in enumerate(sets):
        n = sum(5 * len(one & other) >= 4 * len(one | other) for j, (_, other) in enumerate(sets) if j != i)
        expected[rows[i][0], n] += 1
    found = jaccard_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_links) for r in found) == expected
    assert {r.class_id for r in found if 4 <= r.doc_id <= 10} == {4}
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in jaccard_join.one_per_class(docs).collect()]
    assert sorted(kept) == sorted({r.class_id for r in found})


def test_jaccard_finds_all_links_of_a_group_at_the_threshold(spark):
    """Variants of one text, most pairs with exactly 0.8: not one of some 31,000 links is missed."""
    draw = random.Random(31)
    base, sets, data = [f"w{i}" for i in range(454)], [], []
    for i in range(250):
        words = list(base)
        for slot in draw.sample(range(90), 5):
            words[5 * slot + 2 if slot else 4] = f"v{i}x{slot}"
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)))
        data.append((i, " ".join(words)))
    expected = {i: sum(5 * len(one & other) >= 4 * len(one | other) for j, other in enumerate(sets) if j != i) for i, one in enumerate(sets)}
    found = jaccard_join.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_text_links for r in found} == expected and sum(expected.values()) > 50_000
    assert 1 - (1 - jaccard_join.THRESHOLD ** jaccard_join.prefix_length()) ** jaccard_join.TREES > 1 - 1e-8


def pages_with_boilerplate(n):
    draw = random.Random(n)
    shared = " ".join(f"menu{i}" for i in range(130))
    return [(i, shared + " " + " ".join(f"p{i}w{draw.randrange(10**6)}" for _ in range(80))) for i in range(n)]


def test_pages_that_share_boilerplate_part_into_single_texts(spark):
    """130 of 210 words are the same in 1,500 pages: many are neighbours in some tree, none are links, and no tile is compared."""
    data = pages_with_boilerplate(1500)
    copy = data[7][1].rsplit(" ", 3)[0] + " three other words"
    docs = spark.createDataFrame([*data, (5000, copy)], "doc_id bigint, text string")
    keyed = jaccard_join._keyed(docs, "doc_id", "text")
    members = jaccard_join._with_sets(keyed.select("id", "text").withColumn("root", F.lit(0).cast("bigint")))
    groups = jaccard_join.parted(members.select("root", "id", "shingles"))
    assert groups.count() == 2 and groups.select("root").distinct().count() == 1
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()}
    assert {i: f for i, f in found.items() if f[1]} == {7: (7, 1), 5000: (7, 1)}


def test_the_forest_finds_what_shares_a_prefix(spark):
    """Edges of sorted neighbours hold together the same texts as equal prefixes do, over many partitions."""
    draw = np.random.default_rng(4)
    values = draw.integers(0, 256, (300, 3, 8), dtype=np.uint8)
    values[:, :, :4] //= 86
    packed = [[int(x) for x in (v.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)] for v in values]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(packed)], "id bigint, labels array<bigint>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for length in (3, 4, 6):
            found = {r.id: r.root for r in components(jaccard_join.forest_edges(df, length)).collect()}
            root = list(range(300))
            for tree in range(3):
                first = {}
                for i in range(300):
                    a, b = sorted((root[i], root[first.setdefault(values[i, tree, :length].tobytes(), i)]))
                    root = [a if r == b else r for r in root]
            assert {i: r for i, r in enumerate(root) if root.count(r) > 1} == found
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_per_class_takes_text_ids_and_keeps_every_column(spark):
    df = spark.createDataFrame([("b", "same words here", "x", 1), ("a", "same  words here", "y", 2), (None, "other", None, 3)], "doc_id string, text string, _words string, words int")
    kept = jaccard_join.one_per_class(df)
    assert kept.columns == df.columns and sorted((str(r.doc_id), r._words, r.words) for r in kept.collect()) == [("None", None, 3), ("a", "y", 2)]
    assert {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()} == {("b", "a", 1), ("a", "a", 1), (None, None, 0)}


def test_one_per_class_keeps_a_row_whatever_its_id(spark):
    draw = random.Random(5)
    first, second, third = (sentence(draw, 40) for _ in range(3))
    near = first.rsplit(" ", 1)[0] + " other"
    data = [(None, first), (None, second), (4, near), (7, third), (7, second + " more words here"), (7, third), (9, third)]
    found = jaccard_join.one_per_class(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    # Near copies of null ids go where their class has an id; different texts of the id 7 both stay.
    assert sorted((r.doc_id, r.text) for r in found) == sorted([(4, near), (7, third), (7, second + " more words here")])
    alone = spark.createDataFrame([(None, first), (None, second), (None, second)], "doc_id bigint, text string")
    assert sorted(r.text for r in jaccard_join.one_per_class(alone).collect()) == sorted([first, second])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 100)], "a bigint, b bigint")
    assert {(r.id, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100)}


def test_components_take_a_few_half_rounds_however_long_a_chain_is(spark, monkeypatch):
    written = []
    module = importlib.import_module("tabulon.llm.components")
    plain = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or plain(df, name))
    stars = spark.createDataFrame([(i, i % 3) for i in range(3, 60)] + [(5, 2), (7, 7)], "a bigint, b bigint").repartition(5)
    assert {(r.id, r.root) for r in components(stars).collect()} == {(i, i % 3) for i in range(60)}
    assert len(written) == 1
    written.clear()
    order = random.Random(5).sample(range(600), 600)
    chain = spark.createDataFrame(list(zip(order, order[1:])) + [(-7, -9), (-8, -9)], "a bigint, b bigint").repartition(6)
    assert {(r.id, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(600)} | {(-i, -9) for i in (7, 8, 9)}
    assert len(written) <= 7


def test_all_trees_link_a_group_to_the_same_text(spark):
    draw = random.Random(6)
    alike = spark.createDataFrame([(i, [j << 40 | draw.randrange(1 << 16) for j in range(20)]) for i in range(50)], "id bigint, labels array<bigint>")
    edges = {(r.a, r.b) for r in jaccard_join.forest_edges(alike, 6).collect()}
    assert edges >= {(i, 0) for i in range(1, 50)} and len(edges) < 150


def covered_bytes(texts):
    """Per text which bytes a repeated string covers."""
    counts: Counter = Counter()
    for b in texts:
        counts.update(b[p : p + 200] for p in range(len(b) - 199))
    for b in texts:
        covered = bytearray(len(b))
        for p in range(len(b) - 199):
            if counts[b[p : p + 200]] > 1:
                covered[p : p + 200] = b"\1" * 200
        yield covered


def test_suffixes(docs, rows, empty):
    expected = Counter()
    for (doc_id, text, *_), covered in zip(rows, covered_bytes([(r[1] or "").encode() for r in rows])):
        b = (text or "").encode()
        kept = bytes(x for x, c in zip(b, covered) if not c)
        expected[doc_id, len(b), sum(covered), len(bytes(covered).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()] += 1
    found = suffix_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found) == expected
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_passages_of_every_length_in_many_places(spark):
    """Passages of 195 to 420 bytes that many texts share with other surroundings, over many small partitions and levels of blocks."""
    draw = random.Random(12)
    whole = sentence(draw, 120).encode()[:420].decode("utf-8", "ignore")
    texts = []
    for length in (150, 195, 199, 200, 201, 230, 260, 340, 368, 369, 410):
        begin = draw.randrange(len(whole) - length) if length < len(whole) else 0
        for _ in range(12):
            texts.append(sentence(draw, draw.randint(0, 40)) + whole[begin : begin + length] + sentence(draw, draw.randint(0, 40)))
    texts += ["ab" * 500, "ab" * 101, "x" * 200, "x" * 199, texts[5], texts[5], sentence(draw, 300) * 2]
    df = spark.createDataFrame([(t, i, "n", 3) for i, t in enumerate(texts)], "text string, kept int, z string, _z int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = suffix_dedup.remove_repeats(df, "z").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = Counter()
    for text, covered in zip(texts, covered_bytes([t.encode() for t in texts])):
        expected[text, bytes(x for x, c in zip(text.encode(), covered) if not c), sum(covered)] += 1
    assert Counter((r.text, bytes(r.kept), r.n_removed) for r in found) == expected
    assert found[0].asDict().keys() == {"text", "z", "_z", "n_bytes", "n_removed", "n_spans", "kept"}


@pytest.mark.parametrize("chunk", [150, 700, 1 << 20])
def test_blocks_of_a_text_in_chunks_hold_each_string_once(monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    draw = random.Random(2)
    texts = [sentence(draw, n).encode() for n in (300, 20, 60, 900)] + [b"a" * 3000, b"", b"b" * 199]
    spots: dict[int, list] = {}
    for _, _, _, documents, found in suffix_dedup._whole_blocks(enumerate(texts)):
        for document, spot in zip(documents.tolist(), found.tolist()):
            spots.setdefault(document, []).append(spot)
    for document, data in enumerate(texts):
        for size, parent in suffix_dedup.BLOCKS:
            blocks = [np.array(spots.get(document, []), np.int64)]
            every = [p for b in blocks for _, low, high in [suffix_dedup.starts_of(b)] for x, y in zip(low, high) for p in range(x, y + 1)]
            assert sorted(every) == list(range(max(0, len(data) - 199)))
            if len(blocks[0]):
                spots[document] = [s for *_, out in suffix_dedup._smaller_blocks(data, blocks[0], size, parent) for s in out.tolist()]
        _, low, high = suffix_dedup.starts_of(np.array(spots.get(document, []), np.int64))
        assert (low == high).all() and sorted(low.tolist()) == list(range(max(0, len(data) - 199)))


def test_licenses(docs, empty, spark):
    assert {(r.license, r.dice > 0.7) for r in license_scan.scan(docs, "doc_id", "text", threshold=0.6).collect()} >= {("MIT", True)}
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny"), (2, None), (3, ""), (4, "under the license of words")], "doc_id int, text string")
    assert [(r.doc_id, r.license, r.dice, r.n_lines) for r in license_scan.scan(df, "doc_id", "text").collect()] == [(1, "MIT", 1.0, 1)]
    assert license_scan.scan(empty, "doc_id", "text").count() == 0


def test_license_lines_equal_plain_dice(spark):
    """Every notice with words replaced, dropped or doubled, against Dice over all templates; one line is very long."""
    draw = random.Random(8)
    notices = [(name, n) for name, of_name in license_scan.TEMPLATES.items() for n in of_name]
    lines = []
    for _, notice in notices:
        for changes in range(12):
            words = notice.split()
            for _ in range(changes):
                at = draw.randrange(len(words))
                words[at : at + 1] = draw.choice([[], ["other"], [words[at], words[at]], [words[at].upper() + "!"]])
                words = words or ["x"]
            lines.append(" ".join(words))
    lines.append(sentence(draw, 30_000) + " " + notices[0][1])
    expected = {}
    for i, line in enumerate(lines):
        found = set(license_scan.template_bigrams(line))
        for name, notice in notices:
            template = set(license_scan.template_bigrams(notice))
            dice = 2 * len(found & template) / (len(found) + len(template))
            if dice >= license_scan.THRESHOLD:
                expected[i, name] = max(dice, expected.get((i, name), 0.0))
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    assert {(r.doc_id, r.license): r.dice for r in license_scan.scan(table, "doc_id", "text").collect()} == pytest.approx(expected)
    assert len(expected) > 50


def test_notices_span_lines_and_stand_in_prose(spark, empty):
    apache = "Licensed under the Apache License, Version 2.0."
    mit = license_scan.FULL_TEXTS["MIT"][0].split()
    wrapped = "Copyright (c) 2020 A. Person\n\n" + "\n".join(" ".join(mit[i : i + 11]) for i in range(0, len(mit), 11)) + "\n\nother words"
    texts = [apache.replace("License, ", "License,\n"), f"some prose before {apache} and a lot of other words after it", wrapped, " ".join(mit)]
    texts += [f"{apache}\nwords between\n{apache} words", None, "", "words only, under the license of words"]
    found = license_scan.find_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", "text").collect()
    names = {0: "Apache-2.0", 1: "Apache-2.0", 2: "MIT", 3: "MIT", 4: "Apache-2.0"}
    assert {(r.doc_id, r.license, r.dice, r.n_lines) for r in found} == {(i, n, 1.0, 2 if i == 4 else 1) for i, n in names.items()}
    assert license_scan.find_notices(empty, "doc_id", "text").count() == 0


def test_a_notice_is_only_the_license_it_names(spark):
    texts = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Mozilla Public License, version 2.0.": "MPL-2.0",
        "Released under the BSD 2-Clause License.": "BSD-2-Clause",
        "Licensed under CC0 1.0.": "CC0-1.0",
    }
    texts |= {t: name for name, (t,) in license_scan.FULL_TEXTS.items()}
    names = list(texts.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = license_scan.find_notices(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.license, r.dice, r.n_lines) for r in found) == [(i, name, 1.0, 1) for i, name in enumerate(names)]
    both = spark.createDataFrame([(1, "\n".join(list(texts)[:6]))], "doc_id int, text string")
    assert {r.license for r in license_scan.find_notices(both, "doc_id", "text").collect()} == set(names[:6])


def test_best_window_equals_brute_force(spark):
    """Changed notices between other words, against Dice of every window of the text; SQL-free and without lines."""
    draw, data, expected = random.Random(9), [], {}
    for name, notices in license_scan.TEMPLATES.items():
        for notice in notices:
            for changes in (0, 2, 5):
                words = notice.split()
                for _ in range(changes):
                    at = draw.randrange(len(words))
                    words[at : at + 1] = draw.choice([["other"], [words[at], words[at]], [words[at], "more"]])
                text = sentence(draw, 8) + " " + "\n".join(words) + " " + sentence(draw, 8)
                flat = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
                pairs = [f"{a} {b}" for a, b in zip(flat, flat[1:])]
                template, longest = set(license_scan.template_bigrams(notice)), (len("".join(c if c.isalnum() else " " for c in notice).split()) - 1) * 3 // 2
                spans = [set(pairs[i:j]) for i in range(len(pairs)) for j in range(i + 1, min(i + longest, len(pairs)) + 1)]
                best = max(2 * len(s & template) / (len(s) + len(template)) for s in spans)
                if best >= license_scan.THRESHOLD:
                    expected[len(data)] = (name, best)
                data.append((name, notice, text))
    for i, (name, notice, text) in enumerate(data):
        data[i] = (i, name, notice, text)
    found = {}
    for name, notice in dict.fromkeys((d[1], d[2]) for d in data):
        df = spark.createDataFrame([(d[0], d[3]) for d in data if d[2] == notice], "doc_id int, text string")
        found |= {r.doc_id: (r.license, pytest.approx(r.dice)) for r in license_scan.find_notices(df, "doc_id", "text", {name: (notice,)}).collect()}
    assert found == expected and len(expected) > 20


def test_classifier(spark, empty):
    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scored = classifier.score(docs.select("doc_id", "text"), classifier.fit(docs, labels))
    held = scored.join(labels, "doc_id").where(classifier.id_remainder(F.col("doc_id")) == 0).collect()
    assert sum((r.score >= 0.3) == r.quality for r in held) / len(held) > 0.9
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    nothing = classifier.fit(empty, labels)
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [r.score for r in classifier.score(blank, nothing).collect()] == [0.5, 0.5]


def test_classifier_learns_from_long_words_and_scripts_without_spaces(spark):
    """Good and bad texts differ by words of equal lengths only, or by the characters of unbroken runs."""
    draw = random.Random(21)
    kinds = [("river castle window", "casino lender wagers"), ("学校图书馆文章", "赌场贷款彩票网")]
    data = []
    for i in range(600):
        label, (good, bad) = i % 2, kinds[i // 2 % 2]
        pool = (good if label else bad).split() if " " in good else list(good if label else bad)
        data.append((i, (" " if " " in good else "").join(draw.choice(pool) for _ in range(40)), label))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id bigint, quality int")
    scored = classifier.score(docs, classifier.fit(docs, labels)).collect()
    held = [(r.score >= 0.5) == data[r.doc_id][2] for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and sum(held) / len(held) > 0.95
    a, b, c = (classifier.token_buckets(t)[0] % classifier.BUCKETS for t in ("castle", "window", "CASTLE"))
    assert a != b and a == c and len(classifier.token_buckets("学校图书馆")) == 5


def test_classifier_sums_contexts_of_all_documents(spark, monkeypatch):
    texts = ["one two three", "two four", "five SIX seven six", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    monkeypatch.setattr(classifier, "MAX_FIT_ROWS", 1)
    found = classifier.fit(docs, labels).vectors
    index, sums = classifier.index_vectors(), np.zeros((classifier.BUCKETS, classifier.DIM))
    for text in texts:
        tokens = classifier.token_buckets(text) % classifier.BUCKETS
        for i, j in ((i, j) for i in range(len(tokens)) for j in range(len(tokens)) if 0 < abs(i - j) <= classifier.REACH):
            sums[tokens[i]] += index[tokens[j]]
    assert np.allclose(found, classifier.word_vectors(sums, index), atol=1e-6)
    assert np.abs(found[classifier.token_buckets("seven")[0] % classifier.BUCKETS, classifier.DIM :]).sum() > 0


def test_fingerprints(docs, rows, empty):
    a, b, c = [b"one"], [b"two", b"three"], [b"three", b"one", b"two"]
    one, two, three = map(fingerprints.fingerprint_of, (a, b, c))
    assert (fingerprints.add(one, two) == three).all() and (fingerprints.remove(three, one) == two).all()
    assert (fingerprints.from_text(fingerprints.to_text(three)) == three).all()
    ordered = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    expected = Counter()
    for i, (doc_id, text) in enumerate(ordered):
        n = len(text) // 3
        edited = text[: len(text) - n] + ordered[(i + 1) % len(ordered)][1][:n]
        expected[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    found = fingerprints.compare_with_edit(docs, "doc_id", "text").collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert fingerprints.compare_with_edit(empty, "doc_id", "text").count() == 0


@pytest.mark.parametrize("rows_a_block", [1, 3, 1000])
def test_fingerprints_are_made_once_in_blocks_of_neighbours(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(fingerprints, "ROWS_A_BLOCK", rows_a_block)
    monkeypatch.setattr(fingerprints, "BLOCKS_A_PARTITION", 1 << 20)
    draw = random.Random(rows_a_block)
    texts = ["\n".join(sentence(draw, 5) for _ in range(draw.randint(0, 9))) for _ in range(60)]
    for ids, kind in ((range(60), "bigint"), ([f"d{i}" for i in range(60)], "string")):
        # Null ids, equal ids and equal rows too.
        data = [*zip(ids, texts), *[(None, t) for t in texts[:5]], *[(ids[7], t) for t in (*texts[20:24], None)], *[(ids[9], texts[9])] * 3, *[(None, None)] * 2]
        draw.shuffle(data)
        df = spark.createDataFrame(data, f"doc_id {kind}, text string").repartition(7)
        hashed = df.selectExpr("doc_id", "coalesce(text, '') text").selectExpr("*", "xxhash64(text) h").orderBy("h").collect()
        ordered = sorted((r for r in hashed if r.doc_id is not None), key=lambda r: r.doc_id, reverse=True) + [r for r in hashed if r.doc_id is None]
        expected = Counter()
        for i, r in enumerate(ordered):
            n, following = len(r.text) // 3, ordered[(i + 1) % len(ordered)].text
            edited = r.text[: len(r.text) - n] + following[:n]
            a, b, c = (fingerprints.fingerprint_of(fingerprints.paragraphs(t)) for t in (r.text, edited, following))
            digest = hashlib.sha256(edited.encode()).hexdigest()
            expected[r.doc_id, len(r.text), digest, *map(fingerprints.to_text, (a, b)), fingerprints.likeness(a, b), fingerprints.likeness(a, c)] += 1
        found = fingerprints.compare_with_edit(df, "doc_id", "text")
        # Texts are moved once, to their neighbours, and what is needed of the next one is not joined to them.
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
        assert Counter(map(tuple, found.collect())) == expected


def test_fingerprints_of_more_paragraphs_than_16_bits_count(spark):
    lines = [f"line {i}" for i in range(75_000)]
    one = fingerprints.fingerprint_of([line.encode() for line in lines])
    two = fingerprints.fingerprint_of([line.encode() for line in lines[:50_000]] + [b"other %d" % i for i in range(25_000)])
    assert one[-1] == 75_000 and (fingerprints.from_text(fingerprints.to_text(one)) == one).all()
    assert fingerprints.likeness(one, two) == pytest.approx(2 / 3, abs=0.15)
    # 65,536 paragraphs each: the counts were 0 and all such texts alike.
    many, others = ([b"%s %d" % (kind, i) for i in range(1 << 16)] for kind in (b"a", b"b"))
    assert fingerprints.likeness(fingerprints.fingerprint_of(many), fingerprints.fingerprint_of(others)) < 0.2
    text = "\n".join(lines)
    found = fingerprints.compare_with_edit(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "doc_id", "text").first()
    assert fingerprints.from_text(found.fingerprint)[-1] >= 75_000 and found.near_next == 1.0 and found.near_edited > 0.5


def test_likeness_counts_each_differing_copy_once(spark):
    draw = random.Random(12)
    shared = [sentence(draw, 4) for _ in range(200)]
    texts = ["\n".join(shared + ["again and again"] * 60 + [sentence(draw, 4) for _ in range(40)]) for _ in range(3)]
    texts += ["\n\n".join(shared), "\n".join(shared) + "  two  blanks" * 30, "", "\n\n \n"]
    data = sorted(enumerate(texts), reverse=True)
    found = {r.doc_id: r for r in fingerprints.compare_with_edit(spark.createDataFrame(data, "doc_id bigint, text string"), "doc_id", "text").collect()}

    def true_likeness(one, two):
        a, b = (Counter(fingerprints.paragraphs(t)) for t in (one, two))
        both = a.total() + b.total()
        return 1 - ((a - b).total() + (b - a).total()) / both if both else 1.0

    for at, (doc_id, text) in enumerate(data):
        following, n = data[(at + 1) % len(data)][1], len(text) // 3
        assert found[doc_id].near_next == pytest.approx(true_likeness(text, following), abs=0.15)
        assert found[doc_id].near_edited == pytest.approx(true_likeness(text, text[: len(text) - n] + following[:n]), abs=0.15)
    assert fingerprints.paragraphs("a\n\n\n  \na") == [b"a", b"a"] and b"" not in fingerprints.paragraphs(texts[4])
    once, twice = fingerprints.fingerprint_of([b"x"]), fingerprints.fingerprint_of([b"x", b"x"])
    assert (fingerprints.add(once, once) == twice).all() and (fingerprints.remove(twice, once) == once).all()


def test_fingerprints_of_shared_paragraphs_add_up():
    draw = random.Random(6)
    kinds = [b"p%d" % i for i in range(40)]
    for _ in range(50):
        one, two = ([draw.choice(kinds) for _ in range(draw.randint(0, 90))] for _ in range(2))
        a, b, both = map(fingerprints.fingerprint_of, (one, two, draw.sample(one + two, len(one + two))))
        assert (fingerprints.add(a, b) == both).all() and (fingerprints.remove(both, a) == b).all()
        assert (fingerprints.changed(a, one, two) == b).all()
        assert (fingerprints.from_bytes(fingerprints.to_bytes(both)) == both).all()


def test_estimates_of_differing_paragraphs_are_near_at_every_size():
    for n in (1, 3, 20, 500, 20_000):
        ratios = []
        for trial in range(12):
            old, new = ([b"%d %s %d" % (trial, side, i) for i in range(n)] for side in (b"a", b"b"))
            shared = [b"shared %d" % i for i in range(200)]
            ratios.append(fingerprints.differing(fingerprints.fingerprint_of(old + shared), fingerprints.fingerprint_of(new + shared)) / (2 * n))
        assert np.mean(ratios) == pytest.approx(1, abs=0.12) and max(ratios) < 1.6 and min(ratios) > 0.6


def test_fingerprints_keep_other_columns_and_take_text_ids(spark):
    df = spark.createDataFrame([("a", "x\ny", 1, "z"), ("none", "y\nx", 2, None), (None, "x\ny", 3, "z")], "doc_id string, body string, _text int, text string")
    found = fingerprints.fingerprints(df, "body")
    assert found.columns == [*df.columns, "fingerprint"] and found.select("fingerprint").distinct().count() == 1
    compared = {r.doc_id: r for r in fingerprints.compare_with_edit(df, "doc_id", "body").collect()}
    assert set(compared) == {"a", "none", None} and all(r.near_next == 1.0 for r in compared.values())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() > 0
