"""Benchmark decontamination by winnowing; built-in functions only.

Of every window of consecutive k-gram hashes the least is kept with its place, on both sides. A span shared by a
document and an item that is at least as long as window + k - 1 = 10 words has a window of hashes in common, so
both sides keep the same fingerprint in it: joining fingerprints misses none. Every joined pair is then extended
word by word on its diagonal, which removes chance collisions. Items under 10 words are one window each and are
found by n-grams of their own length: the same pass over the texts keeps those that start with a word whose bit is set
in a table of ``FILTER_BITS`` bits, one for each first word of such items, so common texts give few of them.

Defined results: null or empty texts have no words and no hits; of repeated rows each is reported; an item_id that
occurs twice counts once; null item_ids count as one item, which hits like any other but adds no name to items_sha256;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.nativewords import let, words
from lodestrata.llm.storage import materialise

#: Words of a window of the contract, and words of a k-gram; their difference + 1 hashes make a winnowing window.
SPAN, GRAM = 10, 5
#: A fingerprint is 36 bits of hash and 28 bits of place, packed so that the least one is the leftmost of equal hashes.
PLACE = (1 << 28) - 1
#: Bits of the table of first words; it is broadcast and has this size whatever the items are.
FILTER_BITS = 1 << 18


def _grams(h: Column, n: int) -> Column:
    """Hashes of all n-grams of an array of word hashes of that length at least."""
    return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))


def _pack(g: Column, i: Column) -> Column:
    return F.shiftrightunsigned(g, 1).bitwiseAND(F.lit((1 << 63) - 1 - PLACE)).bitwiseOR(i.cast("long"))


def _kept(g: Column) -> Column:
    wide = SPAN - GRAM + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - wide), lambda i: F.least(*(F.get(g, i + j) for j in range(wide)))))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _fingerprints(h: Column) -> Column:
    """The packed fingerprints of a text's word hashes; null under ``SPAN`` words."""
    return F.when(F.size(h) >= SPAN, let(F.transform(_grams(h, GRAM), _pack), _kept))


def _short_grams(h: Column, lengths: list[int], bits: Column) -> Column:
    """Packed n-grams of these lengths that start with a word of the table."""
    bit = lambda w: w.bitwiseAND(F.lit(FILTER_BITS - 1))
    known = lambda w: F.getbit(F.get(bits, F.shiftright(bit(w), 6).cast("int")), bit(w).bitwiseAND(F.lit(63)).cast("int")) == 1
    starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: known(F.get(h, i)))

    def grams(p: Column, n: int) -> Column:
        fit = F.filter(p, lambda i: i <= F.size(h) - n)
        return F.transform(fit, lambda i: _pack(F.xxhash64(*(F.get(h, i + j) for j in range(n))), i))

    some = lambda p: F.concat(*(grams(p, n) for n in lengths))
    return F.when(F.size(h) > 0, let(starts, some))


def _first_words(items: DataFrame) -> DataFrame:
    """One row: ``bits``, the table of first words as 64-bit words."""
    bit = F.xxhash64(F.get("words", F.lit(0))).bitwiseAND(F.lit(FILTER_BITS - 1))
    some = items.select(F.shiftright(bit, 6).cast("int").alias("at"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit")).distinct()
    some = some.groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word"))
    table = some.agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))  # FILTER_BITS / 64 entries at most
    return table.select(F.transform(F.sequence(F.lit(0), F.lit(FILTER_BITS // 64 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("bits"))


def _unpacked(rows: DataFrame, *keep: str) -> DataFrame:
    rows = rows.select(*keep, F.explode("f").alias("f"))
    return rows.select(*keep, F.shiftright("f", 28).alias("key"), F.col("f").bitwiseAND(F.lit(PLACE)).cast("int").alias("at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and text_key to tell rows of one doc_id apart."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = materialise(items.dropDuplicates(), "items")
    lengths = [r[0] for r in items.where(F.size("words") < SPAN).select(F.size("words")).distinct().collect()]  # nine at most

    parts = lambda h: F.coalesce(_fingerprints(h), F.array().cast("array<long>"))
    rows = texts
    if lengths:
        rows = texts.crossJoin(F.broadcast(materialise(_first_words(items.where(F.size("words") < SPAN)), "first-words")))
        parts = lambda h: F.concat(F.coalesce(_fingerprints(h), F.array().cast("array<long>")), F.coalesce(_short_grams(h, lengths, F.col("bits")), F.array().cast("array<long>")))
    both = let(_hashes(words(F.col("text"))), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), parts(h).alias("f")))
    base = materialise(rows.select("doc_id", "text_key", both.alias("x")).select("doc_id", "text_key", "x.n_words", "x.f"), "fingerprints")
    tagged = items.select("item_id", F.xxhash64("words").alias("item_key"), "words")
    own = F.transform(F.array(F.lit(0)), lambda i: _pack(reduce(lambda out, n: F.when(F.size("words") == n, F.xxhash64(*(F.get("h", F.lit(j)) for j in range(n)))).otherwise(out), lengths, F.lit(None).cast("long")), i))
    hashed = tagged.withColumn("h", _hashes(F.col("words")))
    prints = hashed.select("item_id", "item_key", F.coalesce(_fingerprints(F.col("h")), own).alias("f"))
    prints = materialise(_unpacked(prints, "item_id", "item_key").withColumnRenamed("at", "item_at"), "prints")
    found = _unpacked(base, "doc_id", "text_key").join(prints, "key").select("doc_id", "text_key", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift"))
    found = materialise(found.distinct(), "candidates")

    wanted = found.select("doc_id", "text_key").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    hit_texts = texts.join(wanted, same(texts, wanted), "left_semi").dropDuplicates(["doc_id", "text_key"])
    hit_texts = hit_texts.select("doc_id", "text_key", words(F.col("text")).alias("words"))
    both = found.join(hit_texts, same(found, hit_texts)).select(found["*"], hit_texts["words"].alias("dw"))
    item_words = tagged.select(F.col("item_id").alias("__item"), F.col("item_key").alias("__key"), F.col("words").alias("iw"))
    both = both.join(item_words, both["item_id"].eqNullSafe(item_words["__item"]) & (both["item_key"] == item_words["__key"]))
    first = F.greatest(F.lit(0), -F.col("shift"))  # the part of the item that lies inside the document
    count = F.least(F.size("iw"), F.size("dw") - F.col("shift")) - first
    both = both.select("doc_id", "text_key", "item_id", (F.col("shift") + first).alias("start"), F.least(F.size("iw"), F.lit(SPAN)).alias("n"), F.slice("dw", F.col("shift") + first + 1, count).alias("d"), F.slice("iw", first + 1, count).alias("i"))
    both = both.where(F.size("d") >= F.col("n"))
    begins = let(
        F.struct("d", "i"),
        lambda x: F.filter(F.sequence(F.lit(1), F.size(x["d"]) - F.col("n") + 1), lambda j: F.slice(x["d"], j, F.col("n")) == F.slice(x["i"], j, F.col("n"))),
    )
    runs = both.select("doc_id", "text_key", "item_id", "start", "n", begins.alias("begins")).where(F.size("begins") > 0)
    covered = lambda j: F.sequence(F.col("start") + j - 1, F.col("start") + j + F.col("n") - 2)
    places = F.array_distinct(F.flatten(F.transform("begins", covered)))
    runs = materialise(runs.select("doc_id", "text_key", "item_id", places.alias("places")), "runs")

    hit = runs.select("doc_id", "text_key", F.explode_outer("places").alias("place")).distinct().groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = runs.select("doc_id", "text_key", "item_id").distinct().groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"))
    hit = hit.select(F.col("doc_id").alias("hid"), F.col("text_key").alias("hkey"), "n_hit")
    named = named.select(F.col("doc_id").alias("nid"), F.col("text_key").alias("nkey"), "n_items", "items")
    base = base.select("doc_id", "text_key", "n_words")
    out = base.join(hit, F.col("doc_id").eqNullSafe(F.col("hid")) & (F.col("text_key") == F.col("hkey")), "left")
    out = out.join(named, F.col("doc_id").eqNullSafe(F.col("nid")) & (F.col("text_key") == F.col("nkey")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "text_key",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    bad = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (key == bad["__key"]), "left_anti")
