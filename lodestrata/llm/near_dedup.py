"""MinHash near-dedup by an inverted join of signature coordinates, links confirmed on full shingle sets.

1. Documents with equal shingle sets form one class; its signature has one minimum per hash function.
2. A class is posted under each (coordinate, value) pair. A pair of sets at the threshold agrees in at least
   ``AGREE`` of ``HASHES`` coordinates but for a chance under 2e-9 (75 % agree on average), so each class may drop
   its AGREE - 1 most frequent postings (prefix), and postings of one class are never read again.
3. Posting lists are merged without listing their pairs: first each class is tested against the most central class
   of its lists; lists whose classes are all in one cluster by then are skipped; in the others, classes of
   different clusters are counted against each other in blocks. Agreeing pairs join clusters.
4. Links are confirmed on full shingle sets. First the pairs that joined a cluster, a centre's partners dealt to groups
   of ``STAR_ROWS``; most clusters of copies are one component then and are done. In the others only sets that share a
   shingle of their prefixes can be linked (the rarest of the cluster's shingles, a quarter of the set and one), so
   only those in a list of such a shingle that has several components go on, and only to the blocks of their partners
   there. The largest component's members are never compared with each other.
   Links make the components; the confirmed links that join nothing are not listed.

Words are runs of bytes that are no ASCII white space, after lower-casing A-Z; a shingle is five words, or the whole
sequence where there are fewer. A row goes by its number in the table's partitions, so rows that share a doc_id or a
text are never multiplied; an input that comes out of a shuffle is written down first. Defined results: empty sets are
linked with nothing; repeated rows share a class; a null doc_id is reported but never the component's id while another
is there; long texts go through in pieces, but the distinct shingles of one text (8 bytes each) are held at once, twice
where it is confirmed; an empty table gives an empty result; extra columns are ignored or passed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import textbatch as tb
from lodestrata.llm.frames import unused
from lodestrata.llm.graph import components
from lodestrata.llm.storage import materialise, stable

#: Words of a shingle; a link needs 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Coordinates of a signature, and how many of them a pair must agree in to be looked at.
HASHES, AGREE = 64, 26
#: Rows of a block in the count of collisions and in the exact comparison; partners of a centre in a group.
LIST_BLOCK, SET_BLOCK, STAR_ROWS = 256, 256, 64
#: Tasks that the rows of one long list of a shingle are dealt to; a list of up to LIST_ROWS rows goes to one.
LIST_SALTS, LIST_ROWS = 32, 256
#: Bytes of text that are worked on at once.
SLICE = 1_000_000

_rng = np.random.default_rng(9)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of documents whose words have the hashes ``h``, and where each document's start."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    place = np.arange(len(h))
    left = first[1:][doc] - place  # words from here to the document's end
    total = np.zeros(len(h), np.uint64)
    for j in range(WORDS):
        total += np.where(j < left, padded[place + j], np.uint64(0)) * _PLACE[j]
    value = tb.mix(total + np.minimum(left, WORDS).astype(np.uint64))
    whole = (left >= WORDS) | (place == first[:-1][doc])
    return value[whole], np.concatenate([[0], np.cumsum(np.bincount(doc[whole], minlength=n))])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is several times faster here than the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each document; a long text that comes alone is gone through in pieces."""
    _, _, h, first = tb.runs(tb.LOWER[data], offsets, tb.NOT_SPACE)
    if len(first) > 2 or len(h) <= SLICE:
        value, bounds = _shingles(h, first)
        return [_distinct(value[bounds[d] : bounds[d + 1]]) for d in range(len(first) - 1)]
    parts = (h[lo : lo + SLICE + WORDS - 1] for lo in range(0, len(h) - WORDS + 1, SLICE))
    return [_distinct(np.concatenate([_distinct(_shingles(p, np.array([0, len(p)]))[0]) for p in parts]))]


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, set_key and signature (both null for empty sets)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tb.flat(b.column(2))
            for lo, hi in tb.slices(offsets, SLICE):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size = np.array([len(s) for s in sets], dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum(size)])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                sig = np.empty((hi - lo, HASHES), dtype=np.uint32)
                for k in range(HASHES):
                    sig[:, k] = tb.per_doc(((flat * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), bounds, np.minimum, 0)
                some = size > 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * HASHES, HASHES), pa.int32()), pa.array(sig.view(np.int32).ravel()), mask=pa.array(~some))
                keys = pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(size), keys, lists], ["row", "doc_id", "n_shingles", "set_key", "sig"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sign, "row long, doc_id long, n_shingles long, set_key binary, sig array<int>")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, HASHES)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and where each group starts, from batches sorted by ``keys``."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        cols = [t[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if len(change):
            yield t.slice(0, int(change[-1])), np.concatenate([[0], change[:-1]])
        rest = t.slice(int(change[-1]) if len(change) else 0)
    if rest is not None and rest.num_rows:
        yield rest, np.array([0])


class Forest:
    """Union-find over a block; keeps the pairs that joined something."""

    def __init__(self, labels: np.ndarray):
        self.up: dict[int, int] = {int(x): int(x) for x in labels}
        self.joined: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int, pair: tuple[int, int]) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.joined.append(pair)


EDGES = "a long, b long"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = (_matrix(b.column(2)) == _matrix(b.column(3))).sum(axis=1) >= AGREE
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(same)) for i in (0, 1)], ["a", "b"])


def _count_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per list (or pair of its blocks): pairs of different clusters that agree often enough, as far as they join."""
    for table, bounds in groups(batches, ["key", "left", "right"]):
        cid, label, sig, found = table["cid"].to_numpy(), table["label"].to_numpy(), _matrix(table["sig"]), []
        for lo, hi in zip(bounds, [*bounds[1:], table.num_rows], strict=True):
            if hi - lo < 2:
                continue
            ids, own, s = cid[lo:hi], label[lo:hi], sig[lo:hi]
            names, count = np.unique(own, return_counts=True)
            forest, main = Forest(names), names[np.argmax(count)]
            for i in np.flatnonzero(own != main):
                other = np.flatnonzero(((s == s[i]).sum(axis=1) >= AGREE) & (own != own[i]))
                for j in other:
                    forest.join(int(own[i]), int(own[j]), (int(ids[i]), int(ids[j])))
            found += forest.joined
        yield _edges(found)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= PERCENT * (len(a) + len(b) - inter)


def _links(sets: list[np.ndarray], ids: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Linked pairs of different components that join something, all pairs of the block compared on their full sets."""
    forest, size, n = Forest(comp), np.array([len(s) for s in sets]), len(sets)
    pair = lambda i, j: forest.join(int(comp[i]), int(comp[j]), (int(ids[i]), int(ids[j])))
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                if forest.root(int(comp[i])) != forest.root(int(comp[j])) and _linked(sets[i], sets[j]):
                    pair(i, j)
        return forest.joined
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), size)[shared[inverse]]
    column = column[inverse[shared[inverse]]]
    inter, order = np.zeros((n, n), np.float32), np.argsort(column, kind="stable")
    row, column, width = row[order], column[order], 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        inter += part @ part.T
    inter = np.rint(inter).astype(np.int64)
    close = (100 * inter >= PERCENT * (size[:, None] + size[None, :] - inter)) & (comp[:, None] != comp[None, :])
    for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True):
        pair(i, j)
    return forest.joined


def _set(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _confirm_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the first row of a group, its centre, and the others."""
    for table, bounds in groups(batches, ["hub", "part"]):
        ids, sets, found = table["cid"].to_numpy(), _set(table["shingles"]), []
        for lo, hi in zip(bounds, [*bounds[1:], table.num_rows], strict=True):
            found += [(int(ids[lo]), int(ids[i])) for i in range(lo + 1, hi) if _linked(sets[lo], sets[i])]
        yield _edges(found)


def _confirm_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in groups(batches, ["label", "left", "right"]):
        ids, comp, sets, found = table["cid"].to_numpy(), table["comp"].to_numpy(), _set(table["shingles"]), []
        for lo, hi in zip(bounds, [*bounds[1:], table.num_rows], strict=True):
            found += _links(sets[lo:hi], ids[lo:hi], comp[lo:hi])
        yield _edges(found)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, s in enumerate(b.column(2).to_pylist()):
            s = np.frombuffer(s, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), b.column(j)[i].as_py())) for j in (0, 1)] + [pa.array(s)], ["label", "cid", "shingle"])


def _in_blocks(rows: DataFrame, size: str, block: int) -> DataFrame:
    """Adds left and right: every pair of rows of a group meets in one group of at most two blocks' rows."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    rows = rows.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("left", F.least("__own", "__other")).withColumn("right", F.greatest("__own", "__other")).drop("__own", "__other")


def agreeing_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of classes that agree in AGREE coordinates, as many as make the clusters of all such pairs: a, b."""
    pair = F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long")
    posted = classes.select("cid", F.posexplode("sig").alias("c", "v")).select("cid", pair.alias("key"))
    often = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    by = Window.partitionBy("cid")
    ranked = posted.join(often, "key").withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), F.desc("key")))).withColumn("weight", F.sum("n").over(by))
    prefix = materialise(ranked.where(F.col("rank") >= AGREE).select("key", "cid", "weight"), "prefix")

    centre = prefix.groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("top.cid").alias("centre"))
    near = prefix.join(centre, "key").where("cid <> centre").groupBy("cid", "centre").agg(F.count(F.lit(1)).alias("n"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("n"), "centre"))).where("r <= 2").select("cid", "centre")
    sig = classes.select(F.col("cid").alias("__cid"), "sig")
    near = near.join(sig, F.col("cid") == F.col("__cid")).select("cid", "centre", F.col("sig").alias("s"))
    near = near.join(sig, F.col("centre") == F.col("__cid")).select("cid", "centre", "s", "sig")
    stars = materialise(near.mapInArrow(_agreeing, EDGES), "stars")
    label = components(stars)

    tagged = prefix.select("key", "cid").join(label, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
    tagged = materialise(tagged, "lists")
    mixed = tagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "n")
    lists = tagged.join(mixed, "key").join(sig, F.col("cid") == F.col("__cid")).select("key", "n", "cid", "label", "sig")
    lists = _in_blocks(lists, "n", LIST_BLOCK).drop("n").repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    more = materialise(lists.mapInArrow(_count_lists, EDGES), "merged")
    return stars.union(more).distinct()


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """cid, label and the sorted shingles of each member, whose representative is row ``rep``: one pass over the texts."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    # members grow with the corpus, so they are never broadcast, whatever their size here
    rows = texts.join(members.hint("merge"), F.col("row") == F.col("rep")).select("cid", "label", "set_key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tb.flat(b.column(3))
            sets = [s for lo, hi in tb.slices(offsets, SLICE) for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
            if [_set_key(s) for s in sets] != b.column(2).to_pylist():
                raise RuntimeError("the input gave other rows on its second reading; write it as a table first")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "label", "shingles"])

    return rows.mapInArrow(cut, "cid long, label long, shingles binary")


def star_links(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Which of the edges are links."""
    degree = edges.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("parts"))
    partners = edges.join(degree, F.col("b") == F.col("hub")).select("hub", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("a").alias("cid"))
    centres = degree.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("cid"))
    rows = partners.unionByName(centres).join(sets.select("cid", "shingles"), "cid")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind").select("hub", "part", "cid", "shingles").mapInArrow(_confirm_stars, EDGES)


def prefix_links(members: DataFrame, sets: DataFrame, sure: DataFrame) -> DataFrame:
    """Links between the components that ``sure`` leaves in a cluster, as far as they join something."""
    comp = components(sure)
    tagged = members.select("cid", "label").join(comp.select(F.col("node"), F.col("label").alias("comp")), F.col("cid") == F.col("node"), "left").select("cid", "label", F.coalesce("comp", "cid").alias("comp"))
    tagged = materialise(tagged, "components")
    shape = tagged.groupBy("label", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("main"))
    shape = shape.where("comps > 1 AND n > 2")  # the one pair of a cluster of two has been compared
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / SET_BLOCK)).cast("int")
    shape = shape.select("label", F.col("main.comp").alias("main"), blocks(F.col("n") - F.col("main.n")).alias("minor_blocks"), blocks(F.col("main.n")).alias("main_blocks"))
    pick = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    is_main = F.col("comp") == F.col("main")
    roles = tagged.join(shape, "label").select("label", "cid", "comp", is_main.alias("main"), F.when(is_main, F.col("minor_blocks") + pick("main_blocks")).otherwise(pick("minor_blocks")).alias("own"))
    roles = materialise(roles, "roles")

    open_ = sets.select("cid", "shingles").join(roles.select("cid", "label"), "cid").select("label", "cid", "shingles")
    shingles = materialise(open_.mapInArrow(_exploded, "label long, cid long, shingle long"), "shingles")
    often = shingles.groupBy("label", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    by = Window.partitionBy("cid")
    ranked = shingles.join(often, ["label", "shingle"], "left").withColumn("r", F.row_number().over(by.orderBy(F.coalesce("n", F.lit(1)), "shingle"))).withColumn("size", F.count(F.lit(1)).over(by))
    ahead = F.col("size") - F.floor((F.col("size") * PERCENT + 99) / 100) + 1
    lists = ranked.where(F.col("r") <= ahead).where("n > 1").select("label", "shingle", "n", "cid").join(roles.drop("label"), "cid")
    lists = materialise(lists, "shingle-lists")
    held = lists.groupBy("label", "shingle").agg(F.max("n").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.collect_set("own").alias("all"), F.collect_set(F.when(~F.col("main"), F.col("own"))).alias("minor"))
    # a shingle that a whole cluster shares is one list: its rows are dealt to several tasks
    salts = F.least(F.lit(LIST_SALTS), F.ceil(F.col("n") / LIST_ROWS)).cast("int")
    held = held.where("lo < hi").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("cid"), salts).cast("int")).drop("n")
    met = salted.join(held, ["label", "shingle", "salt"]).select("label", "cid", "comp", "own", F.explode(F.when(F.col("main"), F.col("minor")).otherwise(F.col("all"))).alias("other"))
    met = met.select("label", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "cid", "comp").distinct()
    rows = met.join(sets.select("cid", "shingles"), "cid").select("label", "left", "right", "cid", "comp", "shingles")
    return rows.repartition("label", "left", "right").sortWithinPartitions("label", "left", "right").mapInArrow(_confirm_blocks, EDGES)


def near_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links between classes (cid), as many as make the components."""
    edges = materialise(agreeing_pairs(classes), "agreeing")
    cluster = components(edges).select(F.col("node").alias("cid"), "label")
    members = materialise(cluster.join(classes.select("cid", F.col("rep.row").alias("rep"), "set_key"), "cid"), "clusters")
    sets = materialise(full_sets(docs, members), "sets")
    sure = materialise(star_links(edges, sets), "sure")
    return sure.union(materialise(prefix_links(members, sets, sure), "links"))


def _resolved(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures by row; and by set_key the component: its label and least row, as (no doc_id, doc_id, row)."""
    signed = materialise(signatures(docs), "signatures")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(rep).alias("rep"), F.min("sig").alias("sig"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    label = components(near_links(docs, classes))
    named = classes.join(label, F.col("cid") == F.col("node"), "left").select("set_key", "rep", F.coalesce("label", "cid").alias("label"))
    named = materialise(named, "labels")
    return signed, named.select("set_key", "label").join(named.groupBy("label").agg(F.min("rep").alias("least")), "label")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    signed, named = _resolved(stable(docs.select("doc_id", "text")))
    named = named.select(F.col("set_key").alias("__key"), F.col("least.doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, F.col("set_key") == F.col("__key"), "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, of the least doc_id, and the rows with empty sets; all columns."""
    docs = stable(docs)
    signed, named = _resolved(docs.select("doc_id", "text"))
    kept = named.select(F.col("least.row").alias("__kept")).distinct().union(signed.where("set_key IS NULL").select("row"))
    row = unused(docs, "__row")
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, F.col(row) == F.col("__kept"), "left_semi").drop(row)
