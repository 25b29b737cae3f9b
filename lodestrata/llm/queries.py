"""The queries of this subpackage and their DuckDB oracles, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import conversations, packing, quality, toxicity
from lodestrata.llm.collocations import LEAST, LONGEST, SHARE, TOP, collocations
from lodestrata.llm.decontaminate import decontaminate
from lodestrata.llm.exact_dedup import exact_dedup
from lodestrata.llm.licenses import AGREE, BASE, INDEX_WORDS, SLACK, TEMPLATES, scan_licenses
from lodestrata.llm.mixing import mix_sources
from lodestrata.llm.near_dedup import near_dedup
from lodestrata.llm.suffix_dedup import suffix_dedup
from lodestrata.llm.tokens import training_order
from lodestrata.llm.warc import warc_round_trip

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Target weights of the mix; the other sources share the rest in proportion.
MIX = {"src0": 0.15, "src1": 0.10, "src2": 0.02}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(_table(spark, sf_dir, "documents")).drop("file")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIX)
    return mixed.select("doc_id", "source", "copy_no", F.round("rate", 6).alias("rate"), "mix_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("origin")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")), "present")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ids=False)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_training_order": op2_training_order,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_mix_sources": op6_mix_sources,
    "op7_license_scan": op7_license_scan,
    "op8_warc": op8_warc,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_best_fit_packing": op13_best_fit_packing,
}


def _license_sql() -> str:
    texts = ", ".join(f"({t}, '{label}', string_split('{wording}', ' '), {phrases!r})" for t, (label, wording, phrases) in enumerate(TEMPLATES))
    base = ", ".join(f"('{p}', '{label}', '{p.split()[0]}', {len(p.split())})" for p, label in BASE.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
b AS (SELECT doc_id, label, pos FROM x JOIN (VALUES {base}) AS p(phrase, label, head, n) ON word = head JOIN d USING (doc_id) WHERE array_to_string(w[pos + 1:pos + n], ' ') = phrase),
t(template, label, wording, phrases) AS (VALUES {texts}),
v AS (SELECT template, unnest(wording) AS word, unnest(range(len(wording))) AS place FROM t),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM x WHERE word IN (SELECT word FROM v) GROUP BY word),
q AS (SELECT template, phrase, unnest(string_split(phrase, ' ')) AS word FROM (SELECT template, unnest(phrases) AS phrase FROM t)),
dead AS (SELECT template FROM q LEFT JOIN df USING (word) WHERE df IS NULL),
rare AS (SELECT DISTINCT template, word FROM (SELECT template, word, row_number() OVER (PARTITION BY template, phrase ORDER BY df, -len(word), word) AS r FROM q JOIN df USING (word)) WHERE r = 1),
c AS (SELECT template, word FROM (
        SELECT v.template, v.word, row_number() OVER (PARTITION BY v.template ORDER BY rare.word IS NULL, df, -len(v.word), v.word) AS r
        FROM (SELECT DISTINCT template, word FROM v) AS v JOIN df USING (word) LEFT JOIN rare ON v.template = rare.template AND v.word = rare.word)
      WHERE r <= {INDEX_WORDS} AND template NOT IN (SELECT template FROM dead)),
need AS (SELECT template, least({AGREE}, count(*)) AS need FROM c GROUP BY template),
h AS (SELECT doc_id, template, pos - place AS s FROM x JOIN c USING (word) JOIN v USING (template, word) JOIN t USING (template) JOIN need USING (template)
      WHERE pos - place + len(wording) > 0 GROUP BY doc_id, template, s, need HAVING count(DISTINCT word) >= need),
m AS (SELECT doc_id, label, wording, w[greatest(s, 0) + 1:greatest(s, 0) + len(wording)] AS exact
      FROM h JOIN t USING (template) JOIN d USING (doc_id)
      WHERE len(list_filter(phrases, lambda p: contains(' ' || array_to_string(w[greatest(s - {SLACK}, 0) + 1:s + len(wording) + {SLACK}], ' ') || ' ', ' ' || p || ' '))) = len(phrases)),
k AS (SELECT doc_id, label, len(list_filter(range(1, len(wording) + 1), lambda i: wording[i] = exact[i])) / len(wording) AS score FROM m),
g AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM b GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS names, max(score) AS best FROM (SELECT doc_id, label, 1.0::DOUBLE AS score FROM b UNION ALL SELECT doc_id, label, score FROM k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(g.names, '') AS base_labels, coalesce(a.names, '') AS labels, round(coalesce(best, 0.0::DOUBLE), 6) AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id)"""


def _collocation_sql() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, p[i:i + {n - 1}] AS g FROM p, LATERAL (SELECT unnest(range(1, len(p) - {n - 2})) AS i)" for n in range(1, LONGEST + 1))
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS p FROM t),
totals AS (SELECT lang, sum(len(p)) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM ({grams}) GROUP BY lang, g HAVING count(*) >= {LEAST}),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
         FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) AS c
         JOIN f AS x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f AS y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
spans AS (SELECT lang, f, g[i:j] AS g FROM f, LATERAL (SELECT unnest(range(1, len(g))) AS i), LATERAL (SELECT unnest(range(i + 1, len(g) + 1)) AS j) WHERE j - i + 1 < len(g)),
longer AS (SELECT lang, g, max(f) AS longer FROM spans GROUP BY lang, g)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
       a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best LEFT JOIN longer USING (lang, g) JOIN totals USING (lang) WHERE coalesce(longer, 0) * 100 < a * {SHARE} QUALIFY rank <= {TOP}"""


def _repair_sql() -> str:
    edit = lambda state, cost, letter, line="''": f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 'b': {line} || {state}.b}}"
    far = "{'c': 1000000000, 'a': '', 'b': ''}"
    nl, text = "chr(10)", "d.role || ':' || d.text"
    role = ("user", "user", "assistant", "user")
    add = (2, 2, 3, 2)
    keep = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}

    def before(q: int) -> str:
        choices = [edit(f"s{q}", 3, "D"), f"CASE WHEN must THEN {far} ELSE {edit(f's{add[q]}', '2 + cut', 'R', f'{nl} || {chr(39)}{role[q]}:{chr(39)} || d.text')} END"]
        choices += [f"CASE WHEN NOT must AND d.role[1] = '{x}' THEN {edit(f's{to}', 'cut', 'K', f'{nl} || {text}')} ELSE {far} END" for x, to in keep[q]]
        return f"list_min([{', '.join(choices)}])"

    added = lambda own, other, q: f"list_min([{own}, {edit(other, 2, 'I', f'{nl} || {chr(39)}{role[q]}:{chr(39)}')}])"
    closing = f"SELECT conv_id, i, {added('b0', 't2', 0)} AS s0, {added('b1', 't2', 1)} AS s1, t2 AS s2, t3 AS s3 FROM (SELECT *, {added('b2', 'b3', 2)} AS t2, {added('b3', 'b2', 3)} AS t3 FROM"
    crc = "list_transform(range(256), lambda x: list_reduce([x, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
    nothing = "{'c': 0, 'a': '', 'b': ''}"
    return rf"""
WITH RECURSIVE k AS MATERIALIZED (SELECT {crc} AS crc),
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ord(s)::BIGINT)),
                                         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM conversations, k),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM x WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i FROM g),
m AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             role[1] || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
d AS MATERIALIZED (SELECT conv_id, turn, role, text, i, pair, mark = '' AS blank, mark <> '' AND again AS duplicate, mark = '' OR again AS must,
                          CASE WHEN mark <> '' AND NOT again AND mark NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM m),
r AS ({closing} (SELECT conv_id, max(i) + 1 AS i, {nothing} AS b0, {far} AS b1, {far} AS b2, {nothing} AS b3 FROM d GROUP BY conv_id))
      UNION ALL {closing} (SELECT r.conv_id, d.i, {before(0)} AS b0, {before(1)} AS b1, {before(2)} AS b2, {before(3)} AS b3 FROM r JOIN d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.i = r.i - 1))),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
             CAST(sum(cut) AS BIGINT) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(s0.b[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = 1"""


ORACLES = {
    "op11_collocations": _collocation_sql(),
    "op12_conversation_repair": _repair_sql(),
    "op7_license_scan": _license_sql(),
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS best FROM p)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM h""",
    "op9_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) AS p
      JOIN n AS na ON p.a = na.doc_id JOIN n AS nb ON p.b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, ways.b FROM r JOIN ways ON r.b = ways.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)""",
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, 128 * i AS low, substr(h, 256 * i + 1, 256 + 98) AS h FROM d, LATERAL (SELECT unnest(range(0, len(h) // 256 + 1)) AS i)),
s AS (SELECT doc_id, low + p AS p, substr(h, 2 * p + 1, 100) AS g FROM c, LATERAL (SELECT unnest(range(0, least(128, len(h) // 2 - 49))) AS p)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM s) WHERE doc_id > first),
m AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM f),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m) GROUP BY doc_id, run),
k AS (SELECT doc_id, h, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r JOIN d USING (doc_id)),
o AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{WORD}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
       FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM iw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s)),
m AS (SELECT doc_id, item_id, s, iw.n FROM dw JOIN iw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM m, LATERAL (SELECT unnest(range(s, s + n)) AS q) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "op6_mix_sources": f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in MIX.items())}) AS v(source, target)),
c AS (SELECT source, count(*) AS n, any_value(target) AS target FROM documents LEFT JOIN t USING (source) GROUP BY source),
r AS (SELECT source, coalesce(target, {1.0 - sum(MIX.values())}::DOUBLE * n / sum(CASE WHEN target IS NULL THEN n END) OVER ()) * 1.0::DOUBLE * sum(n) OVER () / n AS rate FROM c),
k AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r, range(0, 120) AS g(k)),
u AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
             CAST('0x' || substr(md5('mix|' || doc_id || '|1'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 AS u FROM documents),
n AS (SELECT doc_id, u.source, text_md5, rate, count(*) AS n FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source AND u.u >= k.cdf GROUP BY ALL)
SELECT doc_id, source, CAST(c AS INTEGER) AS copy_no, round(rate, 6) AS rate, md5('mix|place|' || doc_id || '|' || c) AS mix_key, text_md5
FROM n, LATERAL (SELECT unnest(range(1, n + 1)) AS c)""",
    "op10_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWERED}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t""",
}
