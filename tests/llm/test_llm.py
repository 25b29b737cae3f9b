"""Operators of the llm subpackage against brute force on small tables with awkward rows."""

import hashlib
import re
import tracemalloc
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import decontaminate, exact_dedup, graph, licenses, mixing, near_dedup, quality, queries, suffix_dedup, textbatch, tokens, toxicity, warc
from lodestrata.llm.storage import shared_dir
from tests.oracle import SF, connect, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(3000))
BASE = " ".join(f"b{i}" for i in range(60))
ITEM = "the quick brown fox jumps over the lazy dog near the old river bank today"
TEXTS = [
    None, "", " ", "A b C", "a B c", LONG, LONG, BASE, BASE.replace("b30", "x30"), BASE + " tail", "x " + ITEM + " y", ITEM.upper(), "über ÉCOLE straße 日本語 text",
    "Licensed under CC BY-NC 4.0. All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "one two three", "one  two\tthree", LONG[:4000] + " extra " + LONG[4000:9000],
    "cc by cc by", "x" * 120, "x" * 60,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, words string, score double, keep_id long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", None, "xx"][i % 3], None if i == 4 else "s", len(t or ""), 1, "w", 0.5, 3) for i, t in enumerate(TEXTS)]
    return [*out, out[7], (None, "A b C", "en", "s", 5, 1, "w", 0.5, 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], connect())


def test_words_and_hashes():
    data, offsets = np.frombuffer(b"ab cd ab  x", np.uint8), np.array([0, 5, 5, 11])
    starts, ends, first = textbatch.words(data, offsets, textbatch.NOT_SPACE)
    assert list(zip(starts, ends)) == [(0, 2), (3, 5), (6, 8), (10, 11)] and list(first) == [0, 2, 2, 4]
    h = textbatch.span_hash(textbatch.prefix_hash(data), starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 3


def brute_suffix(rows):
    first, out = {}, []
    for r in sorted(rows, key=lambda r: r[0] if r[0] is not None else 1 << 62):
        own = r[0] if r[0] is not None else 1 << 62
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.get(b[p : p + 50], own) < own:
                gone[p : p + 50] = b"\1" * 50
            first.setdefault(b[p : p + 50], own)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 5_000)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect()), key=str) == brute_suffix(rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_random_overlaps(spark):
    rng = np.random.default_rng(1)
    pool = bytes(rng.integers(97, 101, 3000, dtype=np.uint8)).decode()
    made = []
    for i in range(80):
        a, b = sorted(rng.integers(0, 3000, 2))
        made.append((i, pool[a:b] + "|" * int(rng.integers(0, 3)) + pool[b // 2 : b // 2 + int(rng.integers(30, 90))]))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffix(made)


def test_suffix_dedup_spreads_what_surrounds_a_common_line(tmp_path):
    rng = np.random.default_rng(4)
    line, made = "All of this is from the daily news desk.", []
    for i in range(3000):
        made.append((bytes(rng.integers(97, 123, 60, dtype=np.uint8)).decode() + line + bytes(rng.integers(97, 123, 60, dtype=np.uint8)).decode()).encode())
    job = suffix_dedup._Job(f"file://{tmp_path}", 8)
    fs, base = suffix_dedup.pafs.FileSystem.from_uri(job.folder)
    for k in range(6):
        part = made[k::6]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])])
        suffix_dedup.Chunk(np.arange(k, 3000, 6), offsets, np.frombuffer(b"".join(part), np.uint8), int(offsets[-1])).save(fs, f"{base}/{k:016x}-0.chunk")
    table = lambda batches, key: pa.Table.from_batches(list(batches)).sort_by(key).to_batches()

    def even(rows):
        held = pa.Table.from_batches(rows).to_pandas().assign(size=lambda t: t.body.str.len()).groupby("bucket")["size"].sum()
        assert held.max() < 2 * held.sum() / 8 and held.sum() > 50_000

    first = table(job.first_ranks(iter([pa.RecordBatch.from_pydict({"chunk": list(range(6)), "piece": [0] * 6})])), "bucket")
    contexts = table(job.contexts(iter(table(job.share_first(iter(first)), "chunk"))), "bucket")
    even(contexts)
    status = pa.Table.from_batches(list(job.share_contexts(iter(contexts)))).select(["bucket", "chunk", "piece", "body"]).sort_by("chunk").to_batches()
    even(table(job.strings(iter(status)), "bucket"))


def test_suffix_dedup_common_line(spark):
    rng = np.random.default_rng(5)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    made = [(i, word(40) + "All of this is from the daily news desk." + word(9 if i % 3 else 40)) for i in range(200)]
    made += [(900 + i, "zz" + made[i][1][20:95] + "yy") for i in range(40)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffix(made)


@pytest.mark.parametrize("piece", [100, 173, 1000])
def test_suffix_dedup_of_texts_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", piece)
    rng = np.random.default_rng(13)
    pool = bytes(rng.integers(97, 101, 900, dtype=np.uint8)).decode()
    made = [(i, "".join(pool[a : a + int(rng.integers(20, 400))] for a in rng.integers(0, 900, int(rng.integers(0, 9))))) for i in range(14)]
    made += [(20, "z" * 1730), (21, "z" * 400), (22, pool + pool), (None, pool), (23, None)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffix(made)


def test_suffix_dedup_tells_names_of_equal_halves_apart():
    name, check, doc = (np.array(x, dtype=t) for x, t in (([7, 7, 7, 3, 7], np.uint64), ([1, 2, 1, 1, 2], np.uint64), ([5, 4, 2, 9, 8], np.int64)))
    assert suffix_dedup._by_name(name, check, doc).tolist() == [2, 4, 2, 9, 4]
    where, least, number = suffix_dedup._distinct(name, check, doc)
    assert sorted(least.tolist()) == [2, 4, 9] and least[number].tolist() == [2, 4, 2, 9, 4] and len(set(zip(name[where].tolist(), check[where].tolist()))) == 3


def test_exact_dedup(docs, rows, empty):
    group = defaultdict(list)
    for r in rows:
        group[lower(r[1])].append(r[0])
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs).drop("origin").collect()), key=str)
    best = {k: max((x for x in v if x is not None), default=None) for k, v in group.items()}
    want = [(r[0], best[lower(r[1])], len(group[lower(r[1])]), r[0] == best[lower(r[1])], hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows]
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.deduplicated(docs).where("doc_id IS NOT NULL").select(F.count_distinct("text")).first()[0] > 5


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    levels, slot = exact_dedup.build(keys)
    assert sorted(slot) == list(range(5000)) and (exact_dedup.probe(levels, keys) == slot).all()
    held = keys[np.argsort(slot)]
    strangers = rng.integers(0, 256, (1000, 32), dtype=np.uint8)
    at = exact_dedup.probe(levels, strangers)
    assert not (held[at[at >= 0]] == strangers[at >= 0]).all(axis=1).any()


def brute_near(rows):
    sets, up = [], list(range(len(rows)))
    for r in rows:
        w = lower(r[1]).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    out = []
    for i, r in enumerate(rows):
        c = r[0] if not sets[i] else least.get(root(i))
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return sorted(out, key=str)


def test_near_dedup(docs, rows, empty):
    assert sorted(map(tuple, near_dedup.near_dedup(docs).collect()), key=str) == brute_near(rows)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 32)
    monkeypatch.setattr(near_dedup, "STAR_ROWS", 8)
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(150)]
    made = []
    for i in range(150):
        w = list(base)
        for p in rng.integers(0, 150, int(rng.integers(0, 12))):
            w[p] = f"z{i}_{p}"
        made.append((i, " ".join(w)))
    got = near_dedup.near_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute_near(made)


def test_near_dedup_chains_within_templates(spark, monkeypatch):
    """Clusters of one template with several components: chains of links, texts just under the threshold, copies."""
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "STAR_ROWS", 4)
    monkeypatch.setattr(near_dedup, "LIST_ROWS", 4)
    rng = np.random.default_rng(14)
    made = []
    for t in range(3):
        base = [f"t{t}_{i}" for i in range(60)]
        for k in range(12):
            own = [f"o{t}_{k}_{i}" for i in range(int(rng.integers(8, 40)))]
            for c in range(int(rng.integers(1, 6))):
                cut = int(rng.integers(0, 6))
                made.append((len(made), " ".join(base[cut:] + own + [f"c{c}"] * int(rng.integers(0, 9)))))
    got = near_dedup.near_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(4))
    want = brute_near(made)
    assert len({w[2] for w in want}) > 10 and sorted(map(tuple, got.collect()), key=str) == want


def test_near_dedup_keeps_one_row_of_each_group(spark, docs, clashing):
    out = near_dedup.deduplicated(clashing)
    assert out.columns == clashing.columns
    sets = near_dedup.near_dedup(docs).where("n_shingles > 0").select("component_id").distinct().count()
    assert out.where("length(trim(text)) > 0").count() == sets
    hot = spark.createDataFrame([(None, "a b c d e f g")] * 40 + [(3, "a b c d e f g")] * 40 + [(3, "other words of the same id"), (None, ""), (None, None)], "doc_id long, text string")
    assert sorted(map(str, map(tuple, near_dedup.deduplicated(hot).collect()))) == sorted(map(str, [(3, "a b c d e f g"), (3, "other words of the same id"), (None, ""), (None, None)]))


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["label"] for r in graph.components(edges).collect()} == {0}


def test_decontaminate(spark, docs, rows, empty):
    items = [(1, ITEM), (1, ITEM), (2, "one two three"), (3, None), (4, "..."), (5, "text"), (60, " ".join(f"w{i * 7919 % 1009}" for i in range(100, 130)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if n else ():
            windows[tuple(w[p : p + n])].add(str(i))
    want = []
    for r in rows:
        w, hit, found = WORD.findall(lower(r[1])), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.decontaminate(docs, bench).drop("text_key")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect() if r["doc_id"] is not None) == sorted(w[0] for w in want if not w[5] and w[0] is not None)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontaminate_counts_short_items_of_every_length(spark, tmp_path):
    rng = np.random.default_rng(11)
    word = lambda n: " ".join(f"q{int(x)}" for x in rng.integers(0, 12, n))
    spark.createDataFrame([(i, word(int(rng.integers(0, 80)))) for i in range(60)] + [(60, None), (61, "q1")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"i{n}", word(n)) for n in (1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 14)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    same(queries.op5_decontaminate(spark, str(tmp_path)), queries.ORACLES["op5_decontaminate"], con)


def test_decontaminate_counts_items_without_id(spark, tmp_path):
    long = " ".join(f"v{i}" for i in range(14))
    made = [(1, "x " + ITEM + " y"), (2, "say one two three"), (3, long + " " + ITEM), (4, "nothing here")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(None, ITEM), (None, "one two three"), (7, long), (8, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    same(queries.op5_decontaminate(spark, str(tmp_path)), queries.ORACLES["op5_decontaminate"], con)
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    assert [r["doc_id"] for r in decontaminate.clean(read("documents"), read("benchmark")).collect()] == [4]


def test_mixing(spark, docs, empty):
    out = mixing.mix_sources(docs, {"s": 0.9}, epochs=3.0)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() > 0
    assert mixing.mix_sources(empty, {"s": 0.5}).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    share = {r["source"]: r["count"] / 20_000 for r in mixing.mix_sources(many, {"a": 0.6}, epochs=2.0).groupBy("source").count().collect()}
    assert abs(share["a"] - 1.2) < 0.05 and abs(share["b"] - 0.8) < 0.05
    high = mixing.mix_sources(many.limit(300), {"a": 1.0}, epochs=200.0).groupBy("doc_id").count()
    assert abs(high.agg(F.avg("count")).first()[0] - 800) < 20
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"s": 1.5})


CLASHES = ["rate", "copy_no", "mix_key", "RATE_", "__source", "__salt", "__row", "__parts", "__n", "quality_score", "__text", "score", "label", "n", "a.b", "slot", "tok"]


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c != "score"))


def test_mixing_keeps_columns_of_the_same_names(docs, clashing):
    out = mixing.mix_sources(clashing, {"s": 0.9}, epochs=3.0)
    assert out.columns == [*clashing.columns, "rate__", "copy_no_", "mix_key_"]
    assert {(r["rate"], r["copy_no"], r["mix_key"], r["__n"], r["a.b"]) for r in out.collect()} == {tuple(CLASHES.index(c) for c in ("rate", "copy_no", "mix_key", "__n", "a.b"))}
    plain = mixing.mix_sources(docs, {"s": 0.9}, epochs=3.0)
    assert [tuple(r) for r in out.select("doc_id", "copy_no_", "mix_key_", "rate__").collect()] == [tuple(r) for r in plain.select("doc_id", "copy_no", "mix_key", "rate").collect()]
    assert mixing.repeated(clashing, {"s": 0.9}, epochs=3.0).columns == clashing.columns


def test_mixing_where_rates_are_not_broadcast(spark, docs):
    want = [tuple(r) for r in mixing.mix_sources(docs, {"s": 0.9}, epochs=3.0).collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in mixing.mix_sources(docs, {"s": 0.9}, epochs=3.0).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_quality_keeps_columns_of_the_same_names(spark, docs, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, quality int")
    out = quality.accepted(clashing, labels)
    assert out.dtypes == clashing.dtypes
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in quality.accepted(docs, labels).collect())
    with pytest.raises(ValueError):
        quality.score(clashing, quality.train(docs, labels))
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        kinds = labels.select("doc_id", F.col("quality").alias(column))
        assert sorted(map(str, module.classify(clashing, kinds).collect())) == sorted(map(str, module.classify(docs, kinds).collect()))


def test_trees_are_walked_node_by_node():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3])
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x, y)

    def walk(row):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x]) and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_convolution_and_pooling_place_by_place():
    rng = np.random.default_rng(9)
    net = toxicity._start([rng.integers(0, toxicity.BUCKETS, (30, 5)) for _ in range(8)], np.arange(8) % 2.0, rng)
    net.bias = rng.normal(size=len(net.bias)).astype(np.float32)
    net.out = rng.normal(size=len(net.out)).astype(np.float32)
    sizes = [0, 1, 2, 3, 40, 0, 7]
    docs = [rng.integers(0, toxicity.BUCKETS + 1, (n, 5)).astype(np.int32) for n in sizes]
    first = np.concatenate([[0], np.cumsum(sizes)])

    def score(doc):
        at = lambda i: net.embed[doc[i]].sum(axis=0) if i < len(doc) else np.zeros(toxicity.DIM)
        best = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best.append(max(sum(float(at(p + j) @ net.conv[w][j][:, f]) for j in range(w)) for p in range(len(doc) + 1)))
        z = np.maximum(np.array(best) + net.bias, 0) @ net.out + net.base
        return 1 / (1 + np.exp(-z))

    assert np.allclose(net.score(np.concatenate(docs), first), [score(d) for d in docs], atol=1e-4)


def test_toxicity_thresholds_come_from_rows_that_a_net_did_not_learn_from(spark, monkeypatch):
    rng = np.random.default_rng(10)
    made = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 2000, 30)), "en") for i in range(120)]
    labels = [(i, int(rng.integers(0, 2))) for i in range(120)]  # nothing to be learned
    docs, kinds = spark.createDataFrame(made, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "best_threshold", lambda s, y: seen.append((s.copy(), y.copy())) or 0.5)
    toxicity.train(docs, kinds)
    s, y = seen[0]
    right = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert 0.25 < right < 0.75  # scores of rows that were learned from would tell the labels apart
    few = toxicity.train(docs.union(docs), kinds, words=300)
    assert few.thresholds[None] == toxicity.THRESHOLD  # ten documents of thirty words each: too few to calibrate


def test_licenses(docs, rows, empty):
    want = {}
    for r in rows:
        w, places, labels = WORD.findall(lower(r[1])), [], set()
        for phrase, label in licenses.BASE.items():
            q = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(q)] == q]
            places += at
            labels |= {label} if at else set()
        want[r[0]] = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert {k: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for k, r in got.items()} == want
    assert got[13]["labels"] == "cc-by,cc-by-nc-4.0,reserved" and got[14]["labels"] == "gpl,gpl-3.0" and got[5]["labels"] == ""
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_tell_rows_of_one_id_apart(spark):
    made = [(1, "plain words"), (1, "Licensed under the Apache License, Version 2.0"), (None, "x"), (None, "released under the MIT license"), (None, "released under the MIT license")]
    got = licenses.scan_licenses(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["labels"]) for r in got) == [("1", 2, ""), ("1", 8, "apache-2.0"), ("None", 1, ""), ("None", 5, "mit"), ("None", 5, "mit")]


def test_licenses_find_wording_that_all_files_shorten(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this program."
    got = licenses.scan_licenses(spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")).collect()
    assert {r["labels"] for r in got} == {"mit"}


def test_warc(spark, empty):
    pages = spark.createDataFrame([(1, "http://a/\r\nb", "same"), (2, None, "same"), (2, None, "same"), (3, "ü", None), (4, "u", ""), (None, "u", "lone"), (7, "u", LONG)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.warc_round_trip(pages).where("page_id IS NOT NULL").collect())
    assert got == [(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (7, "response", None, len(LONG))]
    assert {r["record_type"] for r in warc.warc_round_trip(pages, revisit_min=10).collect()} == {"response"}
    assert warc.warc_round_trip(pages.where("false")).count() == 0
    manifest = warc.write_archives(pages, shared_dir(spark, "warc"))
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(manifest, payload=True).where("record_type = 'response'").collect()}
    assert back[7] == LONG and back[2] == "same"


def test_warc_matches_sql_where_payloads_are_equal(spark, tmp_path):
    rng = np.random.default_rng(12)
    made = [(i, f"http://a/{i}", [None, "", "same", "Same", "é" * 9, "x" * 3000, f"own {i}"][int(rng.integers(0, 7))]) for i in range(200)]
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(queries.op8_warc(spark, str(tmp_path)), queries.ORACLES["op8_warc"], con)


def test_warc_rejects_damage():
    raw = warc.encode_record(1, "u", b"hello", None)
    assert warc.decode_record(raw)["payload"] == b"hello"
    for bad in (raw[:-1], raw.replace(b"hello", b"hullo"), raw.replace(b"WARC/1.1", b"WARC/0.9"), raw.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(warc.WarcError):
            warc.decode_record(bad)
    with pytest.raises(warc.WarcError):
        warc.split_archive(b"\x28\xb5\x2f\xfd0000")


def feistel_of_one(high, low, highs, lows, key):
    """The same network on whole Python integers."""
    top, bits = max(1, (highs - 1).bit_length()), max(1, (lows - 1).bit_length())
    bits += (top + bits) % 2
    half = (top + bits) // 2
    keys = [int.from_bytes(hashlib.blake2b(bytes([r]), key=key, digest_size=8).digest(), "little") for r in range(tokens.ROUNDS)]
    while True:
        n = high << bits | low
        left, right = n >> half, n % (1 << half)
        for k in keys:
            f = (right ^ k) * 0x9E3779B97F4A7C15 % (1 << 64)
            f = (f ^ f >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
            left, right = right, left ^ f >> 64 - half
        n = left << half | right
        high, low = n >> bits, n % (1 << bits)
        if high < highs and low < lows:
            return high, low


def test_feistel_is_a_permutation():
    u = np.uint64
    for highs, lows in ((1, 1), (2, 1), (7, 3), (1000, 1), (1, 777), (64, 64), (3, 1 << 10)):
        high, low = np.divmod(np.arange(highs * lows), lows)
        got = tokens.feistel(high, low, highs, lows, b"k")
        assert sorted(zip(*map(np.ndarray.tolist, got))) == list(zip(high.tolist(), low.tolist()))
        assert list(zip(*map(np.ndarray.tolist, got))) == [feistel_of_one(h, x, highs, lows, b"k") for h, x in zip(high.tolist(), low.tolist())]
    rng = np.random.default_rng(6)
    for highs, lows in ((1 << 64, 1), (1 << 64, (1 << 40) + 3), ((1 << 63) + 9, 5), (12, (1 << 61) + 7), (1 << 33, 1 << 62)):
        high = rng.integers(0, highs - 1, 50, dtype=u, endpoint=True)
        low = rng.integers(0, lows, 50).astype(u)
        got = tokens.feistel(high, low, highs, lows, b"k")
        assert list(zip(*map(np.ndarray.tolist, got))) == [feistel_of_one(h, x, highs, lows, b"k") for h, x in zip(high.tolist(), low.tolist())]
    one = lambda k: tokens.feistel(np.arange(99), np.zeros(99, int), 99, 1, k)[0].tolist()
    assert one(b"k") != one(b"l")


def test_training_order_is_the_permutation(spark):
    """Every sequence, its place, order and tokens, against whole integers and the tokenizer itself."""
    rng = np.random.default_rng(7)
    ids = [*range(40), -(1 << 62), 1 << 62, (1 << 62) + 1, *[5] * 3]
    made = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 99, int(rng.integers(0, 60))))) for i in ids]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    out = tokens.write_training_order(docs, shared_dir(spark, "shards"), tokens.load_ranks(), length=32).orderBy("slot").toPandas()
    encode = tokens._encoder(tokens.load_ranks()).encode_ordinary
    low, most, pieces = min(ids), 4, max((len((t or "").encode()) + 32) // 32 for _, t in made)
    highs, lows = max(ids) - low + 1, most * pieces
    want = {}
    for i, t in made:
        seq = np.array([*encode(t), tokens.END], "<u2")
        for p in range(0, len(seq), 32):
            want.setdefault((i, p // 32), []).append(hashlib.sha256(seq[p : p + 32].tobytes()).hexdigest())
    got = defaultdict(list)
    for r in out.itertuples():
        got[r.doc_id, r.piece].append(r.sha256)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    places = [(h % (1 << 64), x) for h, x in zip(out.place_high.tolist(), out.place_low.tolist())]
    assert places == sorted(set(places))
    for r, at in zip(out.itertuples(), places):
        assert at in [feistel_of_one(r.doc_id - low, o * pieces + r.piece, highs, lows, b"order") for o in range(most if r.doc_id == 5 else 1)]


def test_training_order_round_trip(docs, rows, empty):
    out = tokens.training_order(docs).toPandas()
    assert sorted(out["slot"]) == list(range(len(out)))
    encoder, parts = tokens._encoder(tokens.load_ranks()), defaultdict(list)
    for r in out.sort_values("piece").itertuples():
        record = tokens.read_sequence(r.file, r.pos)[0]
        assert (record[r.n_tokens :] == tokens.PAD).all() and hashlib.sha256(record[: r.n_tokens].tobytes()).hexdigest() == r.sha256
        parts[r.doc_id].append(record[: r.n_tokens])
    for doc, text, *_ in rows:
        if doc in (None, 0, 7):  # rows that share an id
            continue
        text = text or ""
        assert encoder.decode(np.concatenate(parts[doc])[:-1].tolist()) == text
    assert tokens.training_order(empty).count() == 0


@pytest.mark.parametrize("stored", [True, False])
def test_training_order_spreads_repeated_documents(spark, tmp_path, monkeypatch, stored):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 20_000)
    made = [(i, f"t{i}") for i in range(300)] + [(7, "hot")] * 150 + [(None, "")] * 40
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(6)
    if stored:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    out = tokens.write_training_order(docs, shared_dir(spark, "shards"), tokens.load_ranks()).orderBy("slot").toPandas()
    assert len(out) == len(made) and list(out["slot"]) == list(range(len(made)))
    assert not out.duplicated(["place_high", "place_low"]).any()
    hot, held = out[out.doc_id == 7], out.groupby("shard").size()
    assert len(hot) == 151 and hot["shard"].nunique() == len(held) > 5 and held.max() < 3 * len(made) / len(held)
    assert (np.diff(hot["slot"]) == 1).mean() < 0.6
    again = tokens.write_training_order(docs.repartition(3), shared_dir(spark, "shards"), tokens.load_ranks(), length=512)
    first = lambda o: sorted(zip(o["place_high"], o["place_low"], o["sha256"]))
    got = again.where("doc_id not in (0, 7)").toPandas()
    assert first(got) == first(out[~out.doc_id.isin([0, 7])])


def test_training_order_of_ids_far_apart(spark):
    made = [(-(1 << 62), "a"), (1 << 62, "b")] + [(5, "c")] * 50
    out = tokens.write_training_order(spark.createDataFrame(made, "doc_id long, text string"), shared_dir(spark, "shards"), tokens.load_ranks()).toPandas()
    assert len(out) == len(made) and not out.duplicated(["place_high", "place_low"]).any()


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, docs, rows, empty, module, column):
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    real = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    scored = module.classify(real, labels).join(labels, "doc_id").where("held_out").select("score", F.col(column).alias("y")).toPandas()
    pairs = scored[scored.y == 1].score.to_numpy()[:, None] - scored[scored.y == 0].score.to_numpy()[None, :]
    assert ((pairs > 0).mean() + (pairs == 0).mean() / 2) > 0.75
    none = labels.where("false")
    got = module.classify(docs, none).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got}) == 1
    assert module.classify(empty, labels).count() == 0
    assert len(module.classify(docs, spark.createDataFrame([(1, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")).collect()) == len(rows)


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.select("slot").distinct().count() == out.count()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name


def test_pipeline_stages_of_awkward_rows(spark, clashing, empty):
    """Nulls, empty and very long texts, repeated rows, clashing names and empty tables, stage by stage."""
    longer = clashing.withColumn("text", F.when(F.col("doc_id") == 12, F.repeat("text", 20_000)).otherwise(F.col("text")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, longer, SF)
        assert after.dtypes == longer.dtypes, name
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in longer.select("doc_id").collect()}, name
        assert stage(spark, empty, SF).count() == 0, name
    out = corpus_pipeline.STAGES[-1][1](spark, longer, SF)
    assert out.select("slot").distinct().count() == out.count() >= longer.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_a_long_text_scores_alike_in_pieces(monkeypatch):
    rng = np.random.default_rng(21)
    docs = [rng.integers(0, toxicity.BUCKETS, (int(n), 1 + len(toxicity.STARTS))).astype(np.int32) for n in rng.integers(3, 30, 60)]
    net = toxicity.fit(docs, (np.arange(60) % 3 == 0).astype(float))
    for size in (1, 7, 40, 10_000):
        monkeypatch.setattr(toxicity, "SLICE", size)
        for text in ("", "  . ", "one", "bad words here. And more Ünïcode, 123 " * 9, "x" * 200, " a b" * 30 + "...", "two. words"):
            data = np.frombuffer(text.encode(), np.uint8)
            whole = net.score(*toxicity.tokens(data, np.array([0, len(data)])))
            assert net.score_long(data) == pytest.approx(whole, abs=1e-6)


def test_runs_of_a_long_text_in_pieces():
    rng = np.random.default_rng(22)
    for _ in range(200):
        data = rng.choice(np.frombuffer(b"ab \n", np.uint8), int(rng.integers(1, 60)), p=rng.dirichlet([1] * 4))
        at = np.array([0, len(data)])
        whole = textbatch.runs(data, at, textbatch.NOT_SPACE)
        for piece in (1, 2, 3, 7):
            assert all(map(np.array_equal, textbatch.runs(data, at, textbatch.NOT_SPACE, piece), whole))


def test_shingles_of_a_long_text_in_pieces(monkeypatch):
    words = np.random.default_rng(23).integers(0, 40, 500)
    data = np.frombuffer(" ".join(f"w{w}" for w in words).encode(), np.uint8)
    whole = near_dedup.shingle_sets(data, np.array([0, len(data)]))[0]
    for size in (1, 3, 100, 496, 499):
        monkeypatch.setattr(near_dedup, "SLICE", size)
        assert np.array_equal(near_dedup.shingle_sets(data, np.array([0, len(data)]))[0], whole)


def test_a_text_of_50_mb_takes_bounded_memory():
    data = np.frombuffer(" ".join(map(str, np.random.default_rng(24).integers(0, 1 << 30, 5_000_000).tolist())).encode(), np.uint8)
    assert len(data) > 48_000_000
    for work in (near_dedup.shingle_sets, quality.statistics):
        tracemalloc.start()
        work(data, np.array([0, len(data)]))
        assert tracemalloc.get_traced_memory()[1] < 10 * len(data)
        tracemalloc.stop()


def test_a_word_does_not_repeat_another_documents():
    one, two = (np.frombuffer(x, np.uint8) for x in (b"spam", b"spamspamspam"))
    alone = quality.statistics(one, np.array([0, 4]))[0]
    assert (quality.statistics(two, np.array([0, 4, 8, 8, 12]))[[0, 1, 3]] == alone).all()


def test_records_that_break_the_format_say_so():
    good = warc.encode_record(5, "http://a/", b"hello", None)
    assert warc.decode_record(good)["page_id"] == 5
    revisit = warc.encode_record(6, None, b"hello", 5)
    assert warc.decode_record(revisit)["refers_to"] == 5
    cases = [good.replace(b"Content-Length: 5\r\n", b""), good.replace(b"WARC-Record-ID", b"X-Record-ID"), good.replace(b"page:5>", b"page:five>"), good.replace(b"http://a/", b"http://\xff/"), good.replace(b"Content-Length: ", b"Content-Length: +"), revisit.replace(b"WARC-Refers-To", b"X-Refers-To"), good[:-3], b"", good.replace(b"WARC/1.1", b"WARC/9.9")]
    for raw in cases:
        with pytest.raises(warc.WarcError):
            warc.decode_record(raw)
