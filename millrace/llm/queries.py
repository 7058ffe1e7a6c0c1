"""The queries opN_<name> over the tables of a folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, exact_dedup, line_dedup, mixing, periodic_runs, quality, secrets, simhash, suffix_dedup, token_store, toxicity, vector_codes
from .common import WS, spread_join, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    def of_kind(k: str):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    counts = [of_kind(k) for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=decontamination.SLACK)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated", F.array_join("near", ",").alias("near_items"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_output(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs; in about a tenth of them, which the ids' CRC chooses, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", f"[{WS}]+"), lambda w: w != ""))
    cut = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    a = (F.col("g") % F.size("w")).cast("int")
    cut = cut.select("doc_id", "text", "w", F.when(F.size("w") > 0, a).alias("a"), "g")
    cut = cut.withColumn("p", F.lit(1) + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)).cast("int"))
    tail = F.transform(F.sequence(F.col("a"), F.size("w") - 1), lambda i: F.element_at("w", F.col("a") + (i - F.col("a")) % F.col("p") + 1))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    rows = rows.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.short")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * longest.length div -longest.short").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    books = vector_codes.train(rows)
    coded = staged(vector_codes.encode(rows, books, keep=("label",)), "vector-codes")
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("kind")
    sums = staged(coded.groupBy(label).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "vector-labels")
    joined = spread_join(coded.select("vec_id", "codes", "error", label), sums, ["kind"], "n")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    digest = F.sha2(F.lit(vector_codes.digits(books)), 256)
    return joined.select("vec_id", code.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def word_tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), word_tokenizer_file())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_secret_scan, op3_source_mixing, op4_simhash_near_dedup, op5_decontamination, op6_token_output, op7_toxicity, op8_suffix_dedup, op9_quality_classifier, op10_line_dedup, op11_periodic_runs, op12_vector_codes, op13_bpe_round_trip)}


def _hits_sql(kind: str, pattern: str) -> str:
    """rid, kind, hit, gap, start of each match."""
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT rid, '{kind}' AS kind, hits[i] AS hit, gaps[i] AS gap, gaps[i + 1] AS after,
         (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d), unnest(range(1, len(hits) + 1)) AS u(i)"""


#: The contract's patterns, as they stand there.
_BASE_SQL = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def _secrets_sql() -> str:
    base = "\n  UNION ALL".join(_hits_sql(kind, pattern) for kind, pattern in _BASE_SQL.items())
    assign = _BASE_SQL["assign"].replace("'", "''")
    added = []
    for c in secrets.CLASSES:
        needs = " AND ".join(f"regexp_matches(hit, '{n}')" for n in c.needs)
        added.append(f"""
  SELECT rid, kind, start + min(k) AS start, start + max(k) + {c.window} AS stop FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY rid, start ORDER BY k) AS island FROM (
      SELECT *, (k - lag(k, 1, -1000000) OVER (PARTITION BY rid, start ORDER BY k) > {c.window})::INT AS fresh FROM (
        SELECT rid, kind, start, k, list_sum(list_transform(map_values(list_histogram(string_split(substr(hit, k + 1, {c.window}), ''))), lambda v: ({c.table})[v::BIGINT + 1])) AS total
        FROM ({_hits_sql(c.kind, c.pattern)}), unnest(range(0, length(hit) - {c.window} + 1)) AS w(k)
        WHERE {needs} AND NOT regexp_matches(gap, '{secrets.ALLOW_BEFORE}'))
      WHERE total <= {c.most}))
  GROUP BY rid, kind, start, island""")
    places = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secrets.KINDS))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({base}),
base AS (
  SELECT rid, kind, start, start + length(hit) AS stop FROM hits
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '{assign}', 2)) >= 6 WHEN 'access' THEN length(hit) >= 20 ELSE length(hit) >= 24 END),
added AS ({" UNION ALL ".join(added)}),
cover AS (
  SELECT rid, start, stop FROM base UNION ALL
  SELECT rid, start - length(regexp_extract(right(gap, {secrets.REACH}), '{secrets.TOKEN}*$')),
         start + length(hit) + length(regexp_extract(left(after, {secrets.REACH}), '^{secrets.TOKEN}*')) FROM ({_hits_sql("allow", secrets.ALLOW)})),
ends AS (
  SELECT rid, kind, pos, sum(open) AS open, sum(over) AS over FROM (
    SELECT rid, kind, unnest([start, stop]) AS pos, unnest([1, -1]) AS open, 0 AS over FROM added UNION ALL
    SELECT rid, kind, unnest([start, stop]), 0, unnest([1, -1]) FROM cover JOIN (SELECT DISTINCT rid, kind FROM added) USING (rid))
  GROUP BY rid, kind, pos),
pieces AS (
  SELECT rid, kind, pos AS start, lead(pos) OVER w AS stop, sum(open) OVER w AS open, sum(over) OVER w AS over
  FROM ends WINDOW w AS (PARTITION BY rid, kind ORDER BY pos)),
every AS (
  SELECT * FROM base UNION ALL
  SELECT rid, kind, start, stop FROM pieces WHERE open > 0 AND over = 0 AND stop - start >= {secrets.LEAST_PIECE}),
spans AS (
  SELECT rid, {counts},
         coalesce(string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, CASE kind {places} END) FILTER (WHERE NOT starts_with(kind, 'entropy')), '') AS base,
         string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, CASE kind {places} END) AS spans
  FROM every GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN spans USING (rid)
"""


def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """The rounds one after the other; each part is a list of whole numbers, each codebook a relation of lists."""
    def assigned(k: int) -> str:
        far = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - b[i]) * (v[i] - b[i])))::BIGINT"
        return f"""
assigned{k} AS MATERIALIZED (
  SELECT row, part, v, min([{far}, entry]) AS best
  FROM cut JOIN book{k} USING (part) GROUP BY row, part, v)"""

    def means(k: int) -> str:
        return f"""
got{k} AS (
  SELECT part, best[2] AS entry, i, floor(sum(v[i])::HUGEINT::DOUBLE / count(*))::BIGINT AS mean
  FROM assigned{k}, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.b, o.b) AS b
  FROM book{k} o LEFT JOIN (SELECT part, entry, list(mean ORDER BY i) AS b FROM got{k} GROUP BY ALL) n USING (part, entry))"""

    steps = [s for k in range(rounds) for s in (assigned(k), means(k))] + [assigned(rounds)]
    return f"""
WITH fit AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT row, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS v
  FROM fit, (SELECT unnest(range(0, {parts})) AS part)),
book0 AS (SELECT part, row - 1 AS entry, v AS b FROM cut WHERE row <= {entries}),{",".join(steps)},
coded AS (
  SELECT row, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error
  FROM assigned{rounds} GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM fit JOIN coded USING (row), digest
"""


ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""",
    "op2_secret_scan": _secrets_sql(),
    "op3_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
total AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
capped AS (SELECT *, 3 * source_size AS cap, (rank - 1) % 3 + 1 AS weight FROM total),
filled AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::BIGINT AS left_size,
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS left_weight
  FROM capped WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, rank, source_size,
         least(cap::DOUBLE, max(left_size / left_weight) OVER () * weight) AS target
  FROM filled),
queued AS (
  SELECT doc_id, size, rank, source_size, target,
         sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id NULLS FIRST, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS served,
         row_number() OVER () AS row
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
entries AS (
  SELECT row, size, (pass * source_size + served)::DOUBLE / target AS finish, rank, pass, served
  FROM queued, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND pass * source_size <= target),
running AS (
  SELECT row, size, sum(size) OVER (ORDER BY finish, rank, pass, served
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM entries),
taken AS (
  SELECT row, sum(size)::BIGINT AS taken FROM running
  WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM queued LEFT JOIN taken USING (row)
""",
    "op5_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i : i + 12] AS w, len(w[i : i + 12]) AS size
  FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT rid, size, i, w[i : i + size - 1] AS w FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
hits AS (SELECT rid, i, size, item_id FROM places JOIN windows USING (size, w)),
words AS (SELECT rid, count(DISTINCT word) AS n_hit FROM hits, unnest(range(i, i + size)) AS u(word) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid),
said AS (SELECT rid, pos, w[pos] AS term FROM d, unnest(range(1, len(w) + 1)) AS u(pos)),
counts AS (SELECT term, count(*) AS n FROM said GROUP BY term),
ranked AS (
  SELECT item_id, w, place, term, row_number() OVER (PARTITION BY item_id, w ORDER BY n, term, place) AS rank
  FROM (SELECT item_id, w, place, w[place] AS term FROM windows, unnest(range(1, len(w) + 1)) AS u(place)) JOIN counts USING (term)),
met AS (SELECT rid, item_id, w, rank, pos - place AS start FROM said JOIN ranked USING (term) WHERE rank <= 2),
near AS (
  SELECT rid, string_agg(item, ',' ORDER BY item) AS near_items FROM (
    SELECT DISTINCT a.rid, a.item_id::VARCHAR AS item
    FROM met a JOIN met b ON a.rid = b.rid AND a.item_id = b.item_id AND a.w = b.w AND a.rank = 1 AND b.rank = 2 AND b.start BETWEEN a.start - 3 AND a.start + 3)
  GROUP BY rid)
SELECT doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
       coalesce(near_items, '') AS near_items
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)
""",
    "op10_line_dedup": r"""
WITH every AS (
  SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, h) AS rid, doc_id, h, string_split(t, chr(10)) AS raw
  FROM (SELECT DISTINCT * FROM every)),
cut AS (
  SELECT * FROM (SELECT rid, no, list_filter(regexp_split_to_array(raw[no], '[\x20\x09-\x0D]+'), lambda x: x != '') AS words,
         list_filter(regexp_split_to_array(regexp_replace(raw[no], '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS tokens
  FROM d, unnest(range(1, len(raw) + 1)) AS u(no))
  WHERE len(words) >= 3 OR length(array_to_string(words, '')) >= 10),
tree AS (
  SELECT rid, no, tokens, [len(tokens)::VARCHAR] || tokens[1:3] AS leaf FROM cut
  WHERE 5 * len(list_filter(tokens, lambda x: x != '<*>')) >= 3 * len(tokens)),
lines AS (
  SELECT rid, no, tokens AS line FROM tree
  UNION ALL
  SELECT rid, no, words FROM cut WHERE 5 * len(list_filter(tokens, lambda x: x != '<*>')) < 3 * len(tokens)),
same AS (SELECT line, min(rid) AS first FROM lines GROUP BY line HAVING count(DISTINCT rid) >= 2),
different AS (SELECT leaf, tokens, count(DISTINCT rid) AS n FROM tree GROUP BY leaf, tokens),
places AS (
  SELECT leaf, tokens, n, place, tokens[place - 1] AS last, tokens[place] AS token
  FROM different, unnest(range(4, len(tokens) + 1)) AS u(place)),
counted AS (SELECT leaf, place, last, token, sum(n) AS n FROM places GROUP BY ALL),
often AS (SELECT leaf, place, token FROM counted GROUP BY ALL HAVING sum(n) >= 3),
most AS (SELECT leaf, place, last, max_by(token, n) AS token FROM counted GROUP BY leaf, place, last HAVING 2 * max(n) > sum(n)),
fixed AS (
  SELECT tokens, list([place::VARCHAR, token] ORDER BY place) AS fixed
  FROM places JOIN most USING (leaf, place, last, token) SEMI JOIN often USING (leaf, place, token)
  WHERE token != '<*>' GROUP BY tokens),
made AS (
  SELECT tokens, coalesce(fixed, []) AS fixed FROM different LEFT JOIN fixed USING (tokens)
  WHERE 5 * (len(list_filter(tokens[1:3], lambda x: x != '<*>')) + coalesce(len(fixed), 0)) >= 3 * len(tokens)),
matched AS (SELECT rid, no, leaf, fixed FROM tree JOIN made USING (tokens)),
general AS (SELECT leaf, fixed, min(rid) AS first FROM matched GROUP BY leaf, fixed HAVING count(DISTINCT rid) >= 3),
gone AS (
  SELECT rid, no FROM lines JOIN same USING (line) WHERE rid != first
  UNION
  SELECT rid, no FROM matched JOIN general USING (leaf, fixed) WHERE rid != first),
lost AS (SELECT rid, list(no) AS numbers FROM gone GROUP BY rid),
kept AS (
  SELECT doc_id, h, raw, numbers,
         array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: NOT coalesce(list_contains(numbers, i), false)), lambda i: raw[i]), chr(10)) AS stay
  FROM d LEFT JOIN lost USING (rid))
SELECT e.doc_id, len(raw) AS n_lines, coalesce(len(numbers), 0) AS n_dropped, sha256(stay) AS kept_sha256
FROM every e JOIN kept k ON e.doc_id IS NOT DISTINCT FROM k.doc_id AND e.h = k.h
""",
    "op11_periodic_runs": r"""
WITH h AS (
  SELECT row_number() OVER () AS rid, doc_id, crc32,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM (
    SELECT *, xor(4294967295, list_reduce(
      list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END)) AS crc32
    FROM documents)),
p AS (
  SELECT rid, doc_id, w, a, 1 + (len(w) - a) // (3 + g % 8) AS p
  FROM (SELECT *, CASE WHEN crc32 % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM (SELECT *, crc32 // 10 AS g FROM h))),
d AS (
  SELECT rid, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w
  FROM p),
grams AS (SELECT rid, i, w[i + 1 : i + 6] AS gram FROM d, unnest(range(0, len(w) - 5)) AS u(i)),
pairs AS (SELECT a.rid, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.rid = b.rid AND a.gram = b.gram AND a.i < b.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs),
found AS (SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length FROM islands GROUP BY rid, q, island HAVING count(*) + 5 >= q),
runs AS (SELECT rid, start, length, min(q) AS period FROM found WHERE length >= 12 GROUP BY rid, start, length),
per AS (
  SELECT rid, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'q': period}, [length, -start, -period]) AS top,
         sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS stay
  FROM (SELECT rid, i, w[i + 1] AS word FROM d, unnest(range(0, len(w))) AS u(i)) ANTI JOIN gone USING (rid, i)
  GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(stay, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (rid) LEFT JOIN kept USING (rid)
""",
    "op12_vector_codes": _codes_sql(4, 256, 4, 1024),
}
