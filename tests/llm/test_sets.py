"""Packing, mixing, sharding, search, the n-gram join and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from semirune.llm import graph, mixing, ngram_join, packing, queries, sharding, topk
from semirune.llm.common import keyed_permutation

WORD = re.compile(r"[^\x20\x09-\x0D]+")

public_tokenizers = pytest.importorskip("public_tokenizers")


# 3


def check_packed(rows, texts, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    want = Counter((len(x), zlib.crc32(np.array(x[s : s + size], "<u4").tobytes()), s, len(x[s : s + size])) for x in ids for s in range(0, len(x), size))
    assert Counter((r.doc_tokens, r.ids_crc32, r.start, r.length) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for placed in at.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= size
    return len(at)


def test_packing(docs, none):
    rows = packing.pack(docs, max_tokens=64).collect()
    texts = [r.text for r in docs.collect()]
    n = check_packed(rows, texts, 64)
    total = sum(r.length for r in rows)
    assert n <= total / 64 * 1.1 + 1
    check_packed(packing.pack(docs).collect(), texts, 2048)
    assert packing.pack(none).count() == 0


def test_patterns():
    rng = random.Random(0)
    for _ in range(50):
        histogram = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 30))}
        found = packing.patterns(histogram, 100)
        used = Counter()
        for count, pattern in found:
            assert sum(pattern) <= 100 and count > 0
            for x in pattern:
                used[x] += count
        assert used == Counter(histogram)
        rows = packing.slots(found)
        assert sum(r["high"] - r["low"] for r in rows) == sum(histogram.values())


@pytest.mark.parametrize("hot", [1, 50, 300, 500, 700, 1000])
def test_fill_with_a_hot_length(hot):
    rng = random.Random(hot)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(4000)]
    histogram = Counter(lengths + [hot] * 2000)
    found = packing.patterns(histogram, 2048)
    assert sum(n * sum(p) for n, p in found) == sum(x * n for x, n in histogram.items())
    assert sum(n for n, _ in found) <= -(-sum(x * n for x, n in histogram.items()) // 2048) * 1.1
    assert len(packing.slots(found)) < 20_000


def test_packing_of_copies(spark):
    texts = [None] * 3000 + ["one two three four five six seven eight nine ten"] * 700 + [f"own {i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df, max_tokens=256).collect()
    assert check_packed(rows, texts, 256) <= sum(r.length for r in rows) / 256 * 1.1 + 1
    assert check_packed(packing.pack(df.where("text IS NULL"), max_tokens=256).collect(), [None] * 3000, 256) == 12


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.encoder("word_bpe_49k.json")
    rng = random.Random(1)
    texts = ["a <|endoftext|> b", "can't we'd it'S 'd'm don'tx", "ŸŽ İı ſ ﬁ ǅ", "a\x00b\x1cc\x85d\xa0e", "12ab_c__! ##%%", ""] + ["".join(chr(rng.randint(32, 400)) for _ in range(50)) for _ in range(200)]
    for x in texts:
        assert np.frombuffer(e(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_patterns_of_one_length():
    packs = lambda histogram: sum(n for n, _ in packing.patterns(histogram, 2048))
    assert packs({600: 1000}) == 334 and packs({512: 100}) == 25 and packs({1: 1000}) == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_other_tokenizers(spark, name, tmp_path):
    """A tokenizer of another form, and one whose file differs in a step, are read by their own rules."""
    import json

    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    other = tmp_path / name
    other.write_text(json.dumps(spec))
    texts = ["Hello World, It is 12 Days", "Éa  b\tC", "", None]
    for p in (path, str(other)):
        t = Tokenizer.from_file(p)
        want = Counter(zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [7], "<u4").tobytes()) for x in texts)
        rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p, 64, 7).collect()
        assert Counter(r.ids_crc32 for r in rows) == want


# 4


def test_targets(spark):
    sizes = {"b": 100, "a": 1000, "": 50, "z": 10, None: 400, "e": 0}
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:  # stop what is above, share the excess again
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    assert {s: r.target for s, r in got.items()} == pytest.approx(target)


def test_mix(docs, none):
    source = docs.select("doc_id", "source", "text", "size")
    mixed = mixing.mix(source, block_words=16)
    rows = mixed.documents.collect()
    assert len(rows) == source.count()
    want = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in source.collect())
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    for of in by.values():
        assert sum(r["size"] for r in of) == of[0].source_size
        assert abs(sum(r.taken for r in of) - of[0].target) <= 33
    again = mixing.mix(source, block_words=16).documents.collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    slots = mixed.slots.groupBy("_source", "block").count().collect()
    assert all(r["count"] <= 2 for r in slots)
    assert mixing.mix(none).documents.count() == 0


def test_mixed_texts(docs):
    source = docs.select("doc_id", "source", "text", "lang")
    mixed = mixing.mix(source, block_words=16)
    taken = Counter()
    for r in mixed.documents.collect():
        taken[str(r.doc_id)] += r.taken
    got = Counter()
    for r in mixing.mixed_documents(source, mixed).collect():
        got[str(r.doc_id)] += len(WORD.findall(r.text))
    assert +taken == +got


def test_mix_of_repeated_rows(spark):
    """Copies of a row have shares of their own; columns may have the names that the operator uses."""
    rows = [(7, "a", prose(1, 90))] * 40 + [(8, None, prose(2, 50)), (None, "b", prose(3, 70)), (None, "b", prose(3, 70)), (9, "a", None), (9, "a", ""), (10, "b", "w " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(i) for i, c in enumerate(("row", "key", "number", "pieces", "words", "copy", "of"))})
    mixed = mixing.mix(df, block_words=16)
    out = mixing.mixed_documents(df, mixed)
    assert out.columns == df.columns
    taken, got = defaultdict(Counter), defaultdict(Counter)
    for r in mixed.documents.where("taken > 0").collect():
        taken[r.doc_id][r.taken] += 1
    for r in out.collect():
        got[r.doc_id][len(WORD.findall(r.text))] += 1
    assert taken == got and sum(taken[7].values()) > 20
    assert mixing.mixed_documents(df.limit(0), mixing.mix(df.limit(0))).count() == 0


def test_keyed_permutation(spark):
    for n in (1, 2, 3, 5, 16, 17, 100, 999):
        rows = spark.range(n).select(keyed_permutation(F.col("id"), F.lit(n).cast("long"), F.lit(1)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


# 6


def test_sharding(docs, none):
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "shard", "slot")
    rows = sharding.shard(keyed, ["doc_id", "h"]).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[i]) for i in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(keyed, ["doc_id", "h"]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard(none.select("doc_id"), ["doc_id"]).count() == 0


def test_sharding_deals_repeated_rows_apart(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.lit(5).alias("doc_id"), F.lit(None).cast("string").alias("place"), F.lit(1).alias("order"), F.lit(2).alias("row"))
    out = sharding.shard(df, ["doc_id", "place"])
    assert out.columns == [*df.columns, "shard", "slot"]
    assert [r["count"] for r in out.groupBy("shard").count().collect()] == [1250] * 16
    # The deal itself: no partition of the first round has many more rows than another.
    dealt = df.withColumn("at", F.monotonically_increasing_id()).groupBy(F.pmod(F.xxhash64(F.lit(sharding.SEED), "doc_id", "place", "at"), F.lit(sharding.PARTITIONS))).count()
    assert dealt.count() == sharding.PARTITIONS and dealt.agg(F.max("count")).first()[0] < 2 * 20_000 / sharding.PARTITIONS


def test_communication_matrix():
    m = sharding.communication_matrix([10, 0, 7, 23], [14, 13, 13], 1)
    assert [sum(r) for r in m] == [10, 0, 7, 23] and [sum(c) for c in zip(*m)] == [14, 13, 13]
    rng = random.Random(0)
    draws = [sharding.hypergeometric(rng, 30, 50, 20) for _ in range(20_000)]
    assert np.mean(draws) == pytest.approx(7.5, abs=0.05) and np.var(draws) == pytest.approx(20 * 0.375 * 0.625 * 60 / 79, rel=0.05)
    assert sharding.hypergeometric(rng, 10**10, 10**10, 10**6) == pytest.approx(5 * 10**5, abs=5000)


# 7


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(5000, None), (5020, [1.0, None] + [0.0] * 6), (5040, [float("nan")] * 8), (5060, [float("inf")] * 8), (None, [0.0] * 8), (6000, [0.5, 0.25]), (6020, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = topk.top_k(topk.integers(df), F.col("vec_id") % 20 == 0, 20, shard_rows=100, query_block=7).collect()
    v = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()}
    want = []
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:20]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(topk.integers(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_ball_tree_prunes():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 50
    points = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 16)))
    s = topk.Search(points[:10], np.arange(10), 20)
    tree = topk.BallTree(points, np.arange(4000), 20)
    s.visit(tree, tree.root, np.arange(10))
    assert s.scored < 10 * 4000 / 2
    full = points[:10] @ points.T
    np.fill_diagonal(full, -np.inf)
    assert (s.scores == -np.sort(-full, axis=1)[:, :20]).all()
    # Of equal points no more than k + 1 are scored, however many there are.
    same = topk.BallTree(np.ones((5000, 4)), np.arange(5000), 20)
    s = topk.Search(np.ones((3, 4)), np.arange(3), 20)
    s.visit(same, same.root, np.arange(3))
    assert s.scored == 3 * 21 and s.found[1].tolist() == [0, *range(2, 21)]


def test_top_k_of_large_numbers(spark):
    """Beyond 2 ** 53 scores stay exact; what may not fit 64 bits raises."""
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-(10**8), 10**8) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=64).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = [(q, i + 1, c, -s) for q in range(0, 300, 50) for i, (s, c) in enumerate(sorted((-dot(rows[q][1], v), c) for c, v in rows if c != q)[:5])]
    assert sorted(map(tuple, got)) == sorted(want) and max(s for *_, s in want) > 2**53
    with pytest.raises(OverflowError):
        topk.top_k(spark.createDataFrame([(1, [2**40, 5]), (2, [2**40, 6])], "vec_id long, v array<long>"), F.lit(True)).collect()
    assert topk.top_k(spark.createDataFrame([(0, []), (20, []), (21, [])], "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0).count() == 4


# 8


def brute_links(rows, threshold=0.8):
    sets = []
    for r in rows:
        w = re.findall(r"\w+", (r.text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links, parent = Counter(), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            met = len(sets[i] & sets[j])
            if (rows[i].text or "") == (rows[j].text or "") or met and met / (len(sets[i]) + len(sets[j]) - met) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r.doc_id)
    least = {k: min((x for x in g if x is not None), default=None) for k, g in groups.items()}
    return Counter((r.doc_id, links[i], least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("block", "most_blocks"), [(512, 24), (2, 24), (2, 1), (1, 0)])
def test_near_classes(docs, none, block, most_blocks):
    """With small blocks, and by components or by bands."""
    rows = docs.select("doc_id", "text").collect()
    got = ngram_join.near_classes(docs, block=block, most_blocks=most_blocks).collect()
    assert Counter((r.doc_id, r.n_links, r.group_id) for r in got) == brute_links(rows)
    assert ngram_join.near_classes(none).count() == 0


def test_keep_one(docs):
    kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
    groups = {g for _, _, g in brute_links(docs.select("doc_id", "text").collect())}
    assert sorted(map(str, kept)) == sorted(map(str, groups))


def test_keep_one_of_each_group_whatever_its_ids(spark):
    text = lambda seed: " ".join(f"w{seed}x{i}" for i in range(40))
    near = text(0) + " more"
    rows = [(None, text(0)), (None, near), (None, text(1)), (None, text(1)), (None, text(2)), (None, "")]
    rows += [(7, text(3)), (7, text(4)), (7, text(4)), (8, text(5)), (None, text(5)), (9, text(5) + " more"), (8, text(6))]
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = (None, text(0)) if (None, text(0)) in got else (None, near)
    assert got == Counter([first, (None, text(1)), (None, text(2)), (None, ""), (7, text(3)), (7, text(4)), (8, text(5)), (8, text(6))])


def test_near_classes_of_a_large_group(spark):
    """A group of many near and exact copies, in which each text has the same links by either way; heavy keys are broadcast."""
    base = prose(77, 200).split()
    texts = [" ".join([*base, f"end{i % 300}"]) for i in range(900)] + [prose(500 + i, 30) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, most_blocks in ((512, 24), (64, 2)):
        got = ngram_join.near_classes(df, block=block, most_blocks=most_blocks).collect()
        assert all((r.n_links, r.group_id, r.copies) == ((899, 0, 3) if r.doc_id < 900 else (0, r.doc_id, 1)) for r in got), (block, got[:3])


@pytest.mark.parametrize("threshold", [0.02, 0.3, 0.8, 0.95])
def test_bands(threshold):
    bands, rows = ngram_join.bands_and_rows(threshold)
    assert 1 - (1 - threshold**rows) ** bands >= ngram_join.RECALL
    assert threshold < 0.1 or bands * rows <= ngram_join.HASHES


def test_join_groups(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 700).alias("k"), "id")
    groups = rows.groupBy(F.col("k").alias("of")).agg(F.count("*").alias("n"), F.max("id").alias("most")).where("of % 3 <> 1")
    got = graph.join_groups(rows, "k", groups, "of", "n", 3000)
    want = rows.join(groups, F.col("k") == F.col("of")).drop("n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    # Only the one heavy key is broadcast.
    assert groups.where(F.col("n") > graph.LIGHT).count() == 1


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(900, 900 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}


# All


def test_queries_are_registered():
    import corpus_pipeline

    names = set(queries.queries())
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert set(queries.oracle_sql()) <= names
    assert len(corpus_pipeline.STAGES) in (4, 5)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before = inputs["near duplicates"].select("doc_id", "text").collect()
    kept = {r.doc_id for r in inputs["secrets"].collect()}
    assert kept == {g for _, _, g in brute_links(before)}
    assert inputs["mixing"].count() == inputs["secrets"].count()
    check_packed(docs.collect(), [r.text for r in inputs["packing"].collect()], 2048)
