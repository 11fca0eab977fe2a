"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.llm import bpe, decontaminate, embeddings, langid, merkle, quality, quotes, repair, sharding, simhash, token_counts, token_files, toxicity
from sparkbars.llm.columns import bounded_batches, fold
from sparkbars.session import cut, scratch_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@register("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    judged = docs.select("doc_id", held_out.alias("held_out"), model.judge(F.col("text")).alias("found"))
    return judged.select("doc_id", "held_out", "found.lang_pred", "found.score")


@register("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.RepetitionRules()
    m = F.col("measured")
    return docs.select("doc_id", quality.measure(F.col("text"), rules).alias("measured")).select(
        "doc_id",
        *[m[c].alias(c) for c in quality.COUNTS],
        quality.base_failed(m).alias("base_failed"),
        quality.kept(m, rules).alias("kept"),
    )


@register("op3_simhash_components")
def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = cut(docs.select("doc_id", simhash.fingerprint(F.col("text")).alias("fingerprint")))
    return simhash.grouped(prints).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op4_decontaminate", f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
         lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS gram
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos,
         unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS gram
  FROM docs CROSS JOIN sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, item_id, size, pos FROM grams JOIN windows USING (size, gram)),
marked AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)
""")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = F.col("contamination")
    judged = cut(decontaminate.find_hits(docs, bench).select(
        "doc_id", found["n_words"].alias("n_words"), decontaminate.hit_words(found, "spans").alias("n_hit"), found["windows"].alias("windows")))
    named = judged.withColumn("own_set", decontaminate.signature(F.col("windows")))
    listed = named.join(decontaminate.items_of(judged, bench), F.col("own_set") == F.col("set"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return listed.select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@register("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", tokens.digest(F.col("text")).alias("d")).select("doc_id", "d.*")


TOKEN_LIMIT = 512


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counter = token_counts.TokenCounter(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    text = F.col("text")
    return docs.select(
        "doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), counter.count(text).alias("c")
    ).select("doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > TOKEN_LIMIT).alias("over_limit"), "c.n_chunks", "c.n_widened")


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


SHARD_BYTES = 1 << 20  # one read of a shuffling loader


@register("op5_shards", f"""
WITH keyed AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce('=' || CAST(doc_id AS VARCHAR), '-') || chr(31) || coalesce('=' || text, '-')), 1, 15) AS BIGINT) AS key
  FROM documents),
levels AS (SELECT d, key >> (60 - d) AS bucket, sum(n_bytes) AS b, count(*) AS n FROM keyed, range(0, 61) r(d) GROUP BY ALL),
closed AS (
  SELECT doc_id, n_bytes, key, min(d) AS depth FROM keyed, levels
  WHERE key >> (60 - d) = bucket AND (b <= {SHARD_BYTES} OR d = 60) GROUP BY ALL)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS slice, CAST(b AS BIGINT) AS shard_bytes, n AS shard_rows, b > {SHARD_BYTES} AS over_limit
FROM closed JOIN levels ON d = depth AND bucket = key >> (60 - depth)
""")
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


@register("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    layout = token_files.Layout()
    tokens = token_files.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, layout)
    folder = f"{scratch_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    manifest, where = token_files.materialise(tokens, folder, layout)
    return where.join(manifest.select("shard", F.col("sha256").alias("shard_sha256")), "shard")


@register("op7_quotation_links", r"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS id, conv_id, turn, role, translate(coalesce(text, ''), chr(1) || chr(2), '') AS text FROM conversations),
cut AS (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM raw),
lines AS (SELECT id, conv_id, turn, pos, len(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]?)+'), '[^>]', '', 'g')) AS level,
                 regexp_replace(line, '^[ \t]*(>[ \t]?)+', '') AS content FROM cut),
own AS (SELECT id, regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS own_text,
               count(*) FILTER (level > 0) AS quoted_lines, max(level) AS quote_depth FROM lines GROUP BY id),
breaks AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM lines),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS block FROM breaks),
blocks AS (SELECT id, block, conv_id, turn, level, string_agg(content, ' ' ORDER BY pos) AS content FROM numbered
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY id, block, conv_id, turn, level),
said AS (SELECT id, block, conv_id, turn, level,
                trim(regexp_replace(lower(unnest(string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), '[^\p{L}\p{N}]+', ' ', 'g')) AS p
         FROM blocks),
passages AS (SELECT DISTINCT conv_id, turn, level, p FROM said WHERE length(p) >= 12),
brief AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g')) AS p FROM blocks b
          WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.id = b.id AND s.block = b.block AND length(s.p) >= 12)),
brief_own AS (SELECT DISTINCT conv_id, turn, p FROM
              (SELECT conv_id, turn, p FROM brief WHERE level = 0 UNION ALL SELECT conv_id, turn, p FROM said WHERE level = 0 AND length(p) < 12) WHERE p <> ''),
firsts AS (SELECT conv_id, p, min(turn) AS original FROM passages WHERE level = 0 GROUP BY ALL),
found AS (
  SELECT conv_id, turn, level, original FROM passages JOIN firsts USING (conv_id, p) WHERE level > 0 AND original < turn
  UNION ALL
  SELECT q.conv_id, q.turn, q.level, max(o.turn) FROM brief q JOIN brief_own o ON o.conv_id = q.conv_id AND o.p = q.p AND o.turn < q.turn
  WHERE q.level > 0 GROUP BY q.conv_id, q.turn, q.level, q.p),
linked AS (SELECT conv_id, turn, max(original) FILTER (level = 1) AS quoted_turn, count(DISTINCT original) AS n_links FROM found GROUP BY ALL),
turns AS (SELECT conv_id, turn, row_number() OVER w - 1 AS reply_order, lag(turn) OVER w AS previous
          FROM (SELECT DISTINCT conv_id, turn FROM raw WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
parents AS (SELECT conv_id, turn, reply_order, coalesce(quoted_turn, previous) AS parent_turn, coalesce(n_links, 0) AS n_links
            FROM turns LEFT JOIN linked USING (conv_id, turn)),
deep AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM parents WHERE parent_turn IS NULL
  UNION ALL SELECT p.conv_id, p.turn, d.depth + 1 FROM parents p JOIN deep d ON p.conv_id = d.conv_id AND p.parent_turn = d.turn)
SELECT raw.conv_id, raw.turn, role, own_text, quoted_lines, CAST(quote_depth AS BIGINT) AS quote_depth, coalesce(n_links, 0) AS n_links,
       parent_turn, depth, reply_order
FROM raw JOIN own USING (id) LEFT JOIN parents p ON p.conv_id = raw.conv_id AND p.turn = raw.turn
LEFT JOIN deep d ON d.conv_id = raw.conv_id AND d.turn = raw.turn
""")
def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_transform(range(0, 8), lambda k: (ord({text}[i]) >> k) & 1)))"
    step = "xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: {step}), 4294967295)"


LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(n_chars: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


def _tree(name: str, nodes: str) -> str:
    return f"""
{name} AS (
  SELECT key, 0 AS level, place, hash, n FROM {nodes}
  UNION ALL SELECT key, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY key, level, place // 2, n),
{name}_sizes AS (SELECT DISTINCT key, level, n FROM {name}),
{name}_proofs AS (
  SELECT a.key, a.place, string_agg(s.hash, '' ORDER BY s.level) AS proof
  FROM {nodes} a JOIN {name} s ON s.key = a.key AND s.place = xor(a.place >> s.level, 1) AND s.n > 1 GROUP BY ALL),
{name}_folds AS (
  SELECT key, place, 0 AS level, start AS hash FROM {nodes}_starts
  UNION ALL
  SELECT f.key, f.place, f.level + 1, sha256(CASE WHEN s.hash IS NULL THEN f.hash WHEN (f.place >> f.level) & 1 = 1 THEN s.hash || f.hash ELSE f.hash || s.hash END)
  FROM {name}_folds f JOIN {name}_sizes z ON z.key = f.key AND z.level = f.level AND z.n > 1
  LEFT JOIN {name} s ON s.key = f.key AND s.level = f.level AND s.place = xor(f.place >> f.level, 1))"""


@register("op12_merkle_manifest", f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, {_leaf("n_chars")} AS hash,
         CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(CAST(n_chars AS HUGEINT) + 1)")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, hash) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM leaves),
placed_starts AS (SELECT key, place, coalesce(changed, hash) AS start FROM placed),
{_tree("lower", "placed").strip()},
subroots AS (SELECT key AS lang_key, '' AS key, hash, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS n FROM lower WHERE n = 1),
folded AS (SELECT f.key, f.place, f.hash FROM lower_folds f JOIN lower_sizes z ON z.key = f.key AND z.level = f.level AND z.n = 1),
subroots_starts AS (SELECT '' AS key, place, hash AS start FROM subroots),
{_tree("upper", "subroots").strip()},
beyond AS (
  SELECT f.key, f.place, s.place AS top_place, 0 AS level, f.hash FROM folded f JOIN subroots s ON s.lang_key = f.key
  UNION ALL
  SELECT f.key, f.place, f.top_place, f.level + 1, sha256(CASE WHEN s.hash IS NULL THEN f.hash WHEN (f.top_place >> f.level) & 1 = 1 THEN s.hash || f.hash ELSE f.hash || s.hash END)
  FROM beyond f JOIN upper_sizes z ON z.level = f.level AND z.n > 1
  LEFT JOIN upper s ON s.level = f.level AND s.place = xor(f.top_place >> f.level, 1))
SELECT p.doc_id, p.hash AS leaf, s.hash AS subroot, r.hash AS root, sha256(coalesce(lp.proof, '') || coalesce(up.proof, '')) AS proof_sha256,
       b.hash AS folded_root, b.hash = r.hash AS verified
FROM placed p JOIN subroots s ON s.lang_key = p.key JOIN upper r ON r.n = 1 JOIN beyond b ON b.key = p.key AND b.place = p.place
JOIN upper_sizes z ON z.level = b.level AND z.n = 1
LEFT JOIN lower_proofs lp ON lp.key = p.key AND lp.place = p.place LEFT JOIN upper_proofs up ON up.place = s.place
""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    longer = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = docs.select(
        "doc_id", "lang", merkle.leaf([F.col(c) for c in LEAF_COLUMNS]).alias("leaf"),
        F.when(tampered, merkle.leaf([longer if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS])).alias("changed"),
    )
    checked = merkle.manifest(rows).withColumn("verified", F.col("folded_root") == F.col("root"))
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_SPACES = r"\x20\x09-\x0D"


@register("op11_conversation_repair", f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
marked AS (SELECT *, {_crc32("name")} % 20 AS fault FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, range(0, CASE WHEN fault = 3 THEN 2 ELSE 1 END) WHERE fault <> 0),
numbered AS (SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '') AS key, turn, role, text,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY key, role, text ORDER BY pos) AS nth, lag(role[1]) OVER (PARTITION BY key ORDER BY pos) || role[1] AS pair,
                regexp_extract(text, '([^{_SPACES}])[{_SPACES}]*$', 1) AS final FROM numbered),
faulty AS (SELECT key, turn, role, text, pos, pair,
                  CASE WHEN NOT regexp_matches(text, '[^{_SPACES}]') THEN 'B' WHEN nth > 1 THEN 'D' WHEN final NOT IN ('.', '!', '?') THEN 'T' ELSE '' END AS fault FROM seen),
counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank,
         count(*) FILTER (fault = 'D') AS duplicate, count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM faulty GROUP BY key),
moves(place, initial, edit, cost, goal, said) AS (VALUES
  (0, 's', 'K', 0, 1, NULL), (0, 'u', 'K', 0, 2, NULL), (1, 'u', 'K', 0, 2, NULL), (2, 'a', 'K', 0, 3, NULL), (3, 'u', 'K', 0, 2, NULL),
  (0, NULL, 'R', 1, 2, 'user'), (1, NULL, 'R', 1, 2, 'user'), (2, NULL, 'R', 1, 3, 'assistant'), (3, NULL, 'R', 1, 2, 'user'),
  (0, NULL, 'D', 2, 0, NULL), (1, NULL, 'D', 2, 1, NULL), (2, NULL, 'D', 2, 2, NULL), (3, NULL, 'D', 2, 3, NULL)),
-- inserted rows before an edit or the end: how many, from where to where
inserts(place, mid, many, said) AS (VALUES
  (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:']),
  (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
walk AS (
  SELECT key, CAST(1 AS BIGINT) AS pos, 0 AS place, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM counts
  UNION ALL
  SELECT key, pos + 1, place, (min(way)).cost, (min(way)).audit, (min(way)).said FROM (
    SELECT w.key, w.pos, m.goal AS place, {{'cost': w.cost + 5 * i.many + m.cost + CASE WHEN f.fault = 'T' AND m.edit <> 'D' THEN 5 ELSE 0 END,
           'audit': w.audit || repeat('I', i.many) || m.edit,
           'said': w.said || i.said || CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [m.said || ':' || f.text] END}} AS way
    FROM walk w JOIN faulty f ON f.key = w.key AND f.pos = w.pos JOIN inserts i ON i.place = w.place
    JOIN moves m ON m.place = i.mid AND (m.initial IS NULL OR m.initial = f.role[1]) AND (m.edit = 'D' OR f.fault NOT IN ('B', 'D')))
  GROUP BY key, pos, place),
ended AS (
  SELECT w.key, min({{'cost': w.cost + 5 * i.many, 'audit': w.audit || repeat('I', i.many), 'said': w.said || i.said}}) AS way
  FROM walk w JOIN counts c ON c.key = w.key AND w.pos = c.n + 1 JOIN inserts i ON i.place = w.place AND i.mid IN (0, 3) GROUP BY w.key),
asked AS (SELECT DISTINCT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '') AS key FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.said, chr(10)), '')) AS repaired_sha256
FROM asked LEFT JOIN counts USING (key) LEFT JOIN ended USING (key)
""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


@register("op13_embedding_neighbours", """
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM vectors WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (SELECT vec_id AS u, vec_id AS v FROM vectors UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v),
roots AS (SELECT u, min(v) AS component_id FROM reached GROUP BY u),
counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN roots r ON r.u = vec_id LEFT JOIN counts c ON c.u = vec_id
""")
def op13_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
