"""Collocations, conversation repair and packing against brute force on small tables with awkward rows."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import collocations, conversations, packing, textbatch

DOCS = "doc_id long, text string, lang string, source string, n long, rank long, w1 string, id long, length int, part string"
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(3000))
TEXTS = [None, "", " ", "A b C", "a B c", LONG, LONG, "über ÉCOLE straße 日本語 ́x y it's 12345", "x" * 5000, "a<|endoftext|>b", "Å  Σ ΑΣ tab\tand\nline", "one two three"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], None, 1, 2, "w", 3, 4, "p") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", "en", None, 1, 2, "w", 3, 4, "p")], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(packing.tokenizer_json())


def test_words_tokenise_like_whole_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 700)
    monkeypatch.setattr(packing, "WORDS", 50)
    words = packing.WordTokens(packing.tokenizer_json())
    more = ["Don't. stop! a's, b.c e.g., (x). «Été», naïve; ÀÉÎ! İstanbul ıI ŒUVRE œuvre. ß. ½. ²x. x²! ﬁn.", "A\u0301 a\u0301. I\u0307 K \u212b \u1e9e .,;: !? .5 5. 5.5", "<|ENDOFTEXT|> <|endoftext|>. X<|startoftext|>Y.", "\x1ca\x1fb\u00a0c\u3000d\u2028e", "\u4e2d\u6587\u3002 \u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35 \U0001f600! \u00ad\u200b", "'S 'LL x'VE. ''re"]
    for t in [*TEXTS, *more, *TEXTS]:
        got = np.frombuffer(packing.document(words, (t or "").encode()), "<u4").tolist()
        assert got == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], t
    assert len(words.known) <= 1100


def test_words_of_real_texts_tokenise_alike(tokenizer):
    words = packing.at_hand(packing.tokenizer_json())
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    for t, e in zip(texts, tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert np.frombuffer(packing.document(words, (t or "").encode()), "<u4").tolist() == [*e.ids, 0]


def test_words_of_many_texts_are_learnt_together(tokenizer, monkeypatch):
    pieces = ["'", "s", "t", "re", "ve", "m", "ll", "d", "a", "é", "É", "ß", "ÿ", "Ÿ", "à", "í", "×", "÷", "Þ", "1", "5", ".", ",", "<", "|", "-", "Q", "µ", "ª", "\u0301", "İ", "日", "\x7f", "\x1c", "\xa0", "~", "`", "@", "ﬁ", "<|endoftext|>"]
    draw = np.random.default_rng(13)
    texts = [" ".join("".join(draw.choice(pieces, draw.integers(1, 7))) for _ in range(20)) for _ in range(400)]
    texts += [None, "", "日本 İ", "plain words only", "x " * 5000, "it's l'été 'tis ''s"]
    words, calls = packing.WordTokens(packing.tokenizer_json()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: calls.append(len(new)) or learn(new))
    monkeypatch.setattr(packing, "SLICE_BYTES", 9_000)
    found = list(packing.documents(words, ((t or "").encode() for t in texts)))
    for t, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], t
    assert len(calls) < len(texts) / 10 and words.cuts


def test_words_of_another_tokenizer_go_through_it_whole(tokenizer):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_str(packing.tokenizer_json())
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Punctuation(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    words, text = packing.WordTokens(other.to_str()), "ab12 don't, x. 7-up"
    assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == [i for w in text.split() for i in other.encode(w, add_special_tokens=False).ids] and not words.cuts


@pytest.mark.parametrize("capacity", [2048, 50, 7])
def test_packing(docs, tokenizer, capacity):
    rows = [r.asDict() for r in packing.pack(docs, capacity=capacity).collect()]
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            body = np.array(ids[start : start + capacity], "<u4").tobytes()
            want[r[0], piece, start, len(body) // 4, zlib.crc32(body), body] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want
    gapless(rows, capacity)
    packed = packing.sequences(packing.pack(docs, capacity=capacity)).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(r["length"] for r in rows) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in packed)


def gapless(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_packing_of_empty_tables(empty):
    assert packing.pack(empty).count() == 0


def brute_bins(lengths, capacity):
    """Item by item: matching of large items, best fit of the others."""
    large, gaps = sorted((x for x in lengths if 3 * x > capacity), reverse=True), []
    while large:
        first = large.pop(0)
        partner = next((i for i, x in enumerate(large) if x + first <= capacity), None)
        gaps.append(capacity - first - (large.pop(partner) if partner is not None else 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= x
        else:
            gaps.append(capacity - x)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_of_every_item(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 90))
    counts = {int(k): int(rng.integers(0, 30)) for k in rng.integers(1, capacity + 1, int(rng.integers(1, 40)))}
    runs = packing.plan(counts, capacity)
    rows, ends = [], {}
    for length, rank, first, each, offset in runs:
        last = min((r[1] for r in runs if r[0] == length and r[1] > rank), default=counts[length])
        rows += [{"sequence_id": first + i // each, "offset": offset + i % each * length, "length": length} for i in range(last - rank)]
        ends[length] = max(ends.get(length, 0), last)
    assert ends == {k: n for k, n in counts.items() if n} and len(rows) == sum(counts.values())
    gapless(rows, capacity)
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert sorted(capacity - n for n in used.values()) == brute_bins([k for k, n in counts.items() for _ in range(n)], capacity)


# Conversations


def brute_repair(rows):
    """The least (cost, audit) by plain recursion from the end; rows are (role, text) in order."""
    seen, marked = set(), []
    counts = Counter()
    for role, text in rows:
        last = (re.findall(r"[^\x20\x09-\x0D]", text) or [""])[-1]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        counts[fault] += 1
        seen.add((role, text))
        marked.append((role, text, fault))
    follow = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    fresh = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
    best = [(0, "", ()), None, None, (0, "", ())]
    for i in range(len(marked), -1, -1):
        if i < len(marked):
            role, text, fault = marked[i]
            now = []
            for q in range(4):
                options = [(best[q][0] + 3, "D" + best[q][1], best[q][2])] if best[q] else []
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    to = follow[q].get(role[:1])
                    if to and best[to]:
                        options.append((best[to][0] + extra, "K" + best[to][1], (f"{role}:{text}", best[to][2])))
                    name, to = fresh[q]
                    options.append((best[to][0] + 2 + extra, "R" + best[to][1], (f"{name}:{text}", best[to][2])))
                now.append(min(options))
            best = now
        for _ in range(3):
            for q in range(4):
                name, to = fresh[q]
                if best[to]:
                    added = (best[to][0] + 2, "I" + best[to][1], (name + ":", best[to][2]))
                    best[q] = min(best[q], added) if best[q] else added
    lines, rest = [], best[0][2]
    while rest:
        lines.append(rest[0])
        rest = rest[1]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    return counts["blank"], counts["duplicate"], counts["truncated"], illegal, best[0][0], best[0][1], hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_conversations(rows):
    found = defaultdict(list)
    for conv, turn, role, text, present in rows:
        found[conv]
        if present:
            role, text = " " if role is None else role, " " if text is None else text
            found[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), turn, text))
    out = []
    for conv, held in found.items():
        held.sort(key=lambda r: r[:4])
        turns = [r[4] for r in held if r[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *brute_repair([(r[2], r[5]) for r in held])))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, present boolean, seq long, code string, cost long"


def turns(rows):
    return [(*r, 1, "c", 5) for r in rows]


def test_repair_of_awkward_conversations(spark):
    rng = np.random.default_rng(3)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Übung"]
    texts = ["Hi.", "no", "", " \t\n", "so?", None, "a\nb!\n ", "ü", "end.\x0b"]
    rows = []
    for conv in range(150):
        for _ in range(int(rng.integers(0, 9))):
            turn = [None, int(rng.integers(0, 6)), int(rng.integers(-3, 30))][int(rng.integers(0, 3))]
            rows.append((conv if conv else None, turn, roles[int(rng.integers(0, 8 if conv % 3 else 3))], texts[int(rng.integers(0, 9))] or texts[0], True))
    rows += [(500, 1, "user", "gone", False), (501, None, None, None, True), (502, -(2**63), "user", "a.", True), (502, 2**63 - 1, "assistant", "b.", True)]
    got = conversations.repair(spark.createDataFrame(turns(rows), SCHEMA).repartition(5), "present").collect()
    want = [(c, min(g, 2**63 - 1), *rest) for c, g, *rest in brute_conversations(rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repair_of_a_conversation_in_many_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(7, i // 2, ["user", "assistant", "system"][int(rng.choice(3, p=[0.5, 0.4, 0.1]))], f"t{int(rng.integers(0, 15000))}{'.' if i % 3 else ''}", True) for i in range(21000)]
    rows += [(c, t, "user", "Hi.", True) for c in (6, 8) for t in range(2)] + [(9, 1, "user", "same.", True)] * 9000
    got = conversations.repair(spark.createDataFrame(turns(rows), SCHEMA).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == brute_conversations(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b!", True) for c in (1, 2, None) for t in [*range(60), None]]
    got = Counter(tuple(r) for r in conversations.damaged(spark.createDataFrame(turns(rows), SCHEMA)).collect())
    want = Counter()
    for c, t, role, text, _ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c, t, "user" if kind == 4 else role, {1: "", 2: "A b"}.get(kind, text), kind != 0] += 2 if kind == 3 else 1
    assert got == want


def test_vectors_are_few_and_checkpoints_change_nothing():
    codes = bytes(np.random.default_rng(5).choice([0, 4, 8, 12, 6, 10, 1], 5000).astype(np.uint8))
    vectors = conversations._vectors(codes, conversations.END)
    assert len(set(vectors)) < 60
    state, plain = 0, []
    for code, behind in zip(codes, vectors[1:]):
        plain.append(conversations._step(state, code, behind))
        state = plain[-1][1]
    assert list(conversations.edits(codes, conversations.END, 0)) == plain


# Collocations


@pytest.mark.parametrize("n,bits", [(2, 4), (2, 17), (3, 5), (3, 21), (4, 14), (4, 31), (4, 32), (2, 32), (3, 32)])
@pytest.mark.parametrize("shard_bits", [0, 4])
def test_filters_lose_nothing(n, bits, shard_bits):
    rng = np.random.default_rng(n * bits)
    ids = np.unique(rng.integers(0, 1 << bits, (3000, n), dtype=np.uint64).astype(np.int64), axis=0)
    h = collocations.half_bits(n, bits)
    left, right = collocations.permute(*collocations.pack(ids, bits), h)
    order, first, _ = collocations.grouped(left, right, h)
    assert len(first) == len(ids)
    left, right, counts, back = left[order], right[order], rng.integers(1, 262, len(ids)), []
    shard = (left >> np.uint64(h - shard_bits)).astype(np.int64)
    for s in np.unique(shard):
        own = shard == s
        body = collocations.to_filter(left[own], right[own], counts[own], h, shard_bits)
        a, b, c = collocations.from_filter(body, int(s), h, shard_bits)
        assert (a == left[own]).all() and (b == right[own]).all() and (c == counts[own]).all()
        assert len(body) < own.sum() * (2 * h / 8 + 4) + 300
        back.append(collocations.unpack(*collocations.restore(a, b, h), n, bits))
    assert {tuple(x) for x in np.concatenate(back).tolist()} == {tuple(x) for x in ids.tolist()}


def brute_collocations(rows, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= 30}
        drop = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * counts[p[i:j]]}
        held = []
        for p, a in cand.items():
            if p not in drop:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                held.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, le, ri, n[lang], -s) for r, (s, a, p, le, ri) in enumerate(sorted(held)[:top])]
    return sorted(out)


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(spark, monkeypatch, top):
    monkeypatch.setattr(collocations, "TOP", top)
    rng = np.random.default_rng(8)
    vocabulary = ["The", "the", "of", "é", "日本", "a", "b", "c's", "'", " ", "z" * 300]
    rows = []
    for i in range(260):
        words = [vocabulary[min(10, int(x))] for x in rng.exponential(2.5, int(rng.integers(0, 60)))]
        rows.append(("".join(w + ["  ", " ", "\t", ".", ", ", "\n", " ", " "][int(rng.integers(0, 8))] for w in words), [None, "en", "de", "und"][int(rng.integers(0, 4))]))
    rows += [(None, "en"), ("", "fr"), ("x y z w v", "fr")] + [("x y z w. q q q q q", "es")] * 40 + [("one", "it")] * 31
    table = [(i, t, g, None, 1, 2, "w", 3, 4, "p") for i, (t, g) in enumerate(rows)]
    got = collocations.collocations(spark.createDataFrame(table, DOCS).repartition(4))
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, top)


def test_collocations_of_empty_tables(empty, docs):
    assert collocations.collocations(empty).count() == 0 and collocations.collocations(docs.where("doc_id < 3")).count() == 0


def test_long_texts_are_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 50)
    texts = ["ab cd. " * 40, "no stop " * 30, "", "x. y"]
    found = list(collocations._pieces(iter([pa.RecordBatch.from_pydict({"lang": ["a", "b", "c", "d"], "text": texts})])))
    assert b"".join(d.tobytes() for d, _, _ in found).decode() == "".join(texts)
    cuts = [d[: o[1]].tobytes() for d, o, _ in found]
    assert len(cuts) > 5 and all(x.endswith((b".", b"stop ")) or len(x) < 60 for x in cuts)


def test_counts_of_words_are_whole(spark, docs):
    _, words, totals = collocations.frequent_phrases(docs)
    want = Counter()
    for r in docs.select(F.coalesce("lang", F.lit("und")), "text").collect():
        want[r[0]] += len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", r[1] or ""))
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(want) and words.where("f < 30").count() == 0


def test_a_chunk_is_encoded_in_bounded_memory(tmp_path):
    words = [f"w{i * 7919 % 300_007}" for i in range(150_000)]
    texts = [" ".join(words[lo : lo + 10_000]) + "." for lo in range(0, len(words), 10_000)] * 9
    size = sum(map(len, texts))
    assert collocations.CHUNK_BYTES < size < 1.3 * collocations.CHUNK_BYTES
    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * len(texts), "text": texts})
    tracemalloc.start()
    try:
        counts = Counter()
        for b in collocations._Job(f"file://{tmp_path}").encode(iter([batch])):
            counts.update(dict(zip(zip(b["part"].to_pylist(), b["word"].to_pylist()), b["n"].to_pylist())))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(counts.values()) == 9 * len(words) and {w for _, w in counts} == set(words)
    assert peak < 22 * collocations.CHUNK_BYTES


@pytest.mark.parametrize("block", [1, 9, 40, 1 << 17])
def test_words_are_hashed_alike_in_any_blocks(monkeypatch, block):
    monkeypatch.setattr(textbatch, "BLOCK", block)
    data, offsets = textbatch.flat(pa.array(["b a b", None, "", "a" * 60 + " b " + "a" * 60, " a\tb "]))
    starts, ends, _ = textbatch.words(data, offsets, textbatch.NOT_SPACE)
    salt = np.array([0, 0, 0, 1, 1, 1, 0, 1])
    where, kind = textbatch.distinct(data, starts, ends, salt)
    spelled = [(int(s), data[a:b].tobytes()) for s, a, b in zip(salt, starts, ends)]
    assert [spelled[i] for i in where[kind]] == spelled and len(where) == len(set(spelled))
