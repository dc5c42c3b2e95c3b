"""The registered queries of the corpus operators, and SQL for the same results."""

from pyspark.sql import functions as F

from newslens.llm import (
    conversation_trie,
    decontamination,
    license_scan,
    line_dedup,
    mixing,
    periodic_runs,
    pii,
    quality_rules,
    simhash,
    substring_dedup,
    training_order,
    voronoi_topk,
    web_archives,
)
from newslens.llm.tables import read_table
from newslens.session import scratch_path


# The registered query's key; whoever keeps data private takes a secret.
PII_KEY = "op8"


def op1_quality_rules(spark, sf_dir):
    judged = quality_rules.verdicts(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op2_training_order(spark, sf_dir):
    """Every token sequence of the documents with its slot, written as shard files and read back in slot order."""
    return training_order.through_shards(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    """Every document with the numbers of its lines that repeat earlier ones."""
    return line_dedup.line_decisions(read_table(spark, sf_dir, "documents"))


def op4_warc_packages(spark, sf_dir):
    """Every page written into ZIP packages of WARC records, and read back by ranges."""
    path = scratch_path(spark, "warc-packages")
    web_archives.write_packages(read_table(spark, sf_dir, "pages"), path)
    records = web_archives.read_packages(spark, path)
    return records.select(
        web_archives.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        web_archives.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op5_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


def op6_source_mixing(spark, sf_dir):
    """A row per draw of a document, with its place in the source's epoch."""
    return mixing.draws(read_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark, sf_dir):
    """A row per leak: a document, and a benchmark item of which it holds 80 % or more."""
    leaks = decontamination.find_leaks(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return leaks.select("doc_id", "item_id", "n_shingles", "n_found")


def op8_pii_surrogates(spark, sf_dir):
    """Every document with its personal data replaced."""
    return pii.replace_entities(read_table(spark, sf_dir, "documents"), PII_KEY)


def op9_license_scan(spark, sf_dir):
    """A row per licence notice of the documents."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op10_simhash_near_dup(spark, sf_dir):
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_periodic_runs(spark, sf_dir):
    """Every document, some with a planted periodic ending, with its runs and the text without them."""
    docs = periodic_runs.with_planted_runs(read_table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic_runs(docs)
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(
            r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")
        ))
    )
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")
    ))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_voronoi_topk(spark, sf_dir):
    """The five nearest rows, by inner product, of each vector whose id is divisible by 50."""
    vectors = voronoi_topk.whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return voronoi_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op13_conversation_trie(spark, sf_dir):
    """A row per distinct beginning of the conversations, rebuilt on the first of their family."""
    return conversation_trie.branched_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_training_order": op2_training_order,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc_packages": op4_warc_packages,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_license_scan": op9_license_scan,
    "op10_simhash_near_dup": op10_simhash_near_dup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_voronoi_topk": op12_voronoi_topk,
    "op13_conversation_trie": op13_conversation_trie,
}

# Words of a text, as every contract takes them. \\x0B and \\x0C are \\v and \\f.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RATES = quality_rules.SLACK
_PASSES = " AND ".join(f"{r} <= max_{r}" for r in _RATES) + " AND word_length >= min_word_length"
_BOUNDS = ", ".join(
    f"max(CASE WHEN rate = '{r}' THEN q3 + {quality_rules.RANGES} * (q3 - q1) + {slack} END) AS max_{r}"
    for r, slack in _RATES.items()
) + (
    f", max(CASE WHEN rate = 'word_length' THEN q1 - {quality_rules.RANGES} * (q3 - q1) "
    f"- {_RATES['word_length']} END) AS min_word_length"
)
_OP1 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
    {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d),
windows AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS k FROM starts),
twice AS (SELECT r, k FROM windows GROUP BY r, k HAVING count(*) > 1),
spots AS (SELECT DISTINCT r, unnest(range(i, i + 8)) AS p FROM windows SEMI JOIN twice USING (r, k)),
repeats AS (SELECT r, count(*) AS n FROM spots GROUP BY r),
counts AS (
  SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '{quality_rules.SYMBOLS}', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM d LEFT JOIN repeats USING (r)),
base AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS}
    OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
rated AS (
  SELECT *, 1000 * n_symbols // nullif(n_words, 0) AS symbol_rate,
    1000 * n_dup_lines // nullif(n_lines, 0) AS dup_line_rate,
    1000 * n_repeat_words // nullif(n_words, 0) AS repeat_rate,
    100 * word_chars // nullif(n_words, 0) AS word_length FROM base),
long AS (
  UNPIVOT (SELECT lang, source, {", ".join(_RATES)} FROM rated WHERE NOT base_failed)
  ON {", ".join(_RATES)} INTO NAME rate VALUE v),
bucketed AS (
  SELECT lang, source, rate, CASE WHEN v < 128 THEN v
    ELSE (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) END AS b FROM long),
levels AS (
  SELECT 0 AS level, lang, source, rate, b FROM bucketed
  UNION ALL SELECT 1, lang, NULL, rate, b FROM bucketed
  UNION ALL SELECT 3, NULL, NULL, rate, b FROM bucketed),
quartiles AS (
  SELECT level, lang, source, rate, count(*) AS n, quantile_disc(b, 0.25) AS q1,
    quantile_disc(b, 0.75) AS q3 FROM levels GROUP BY ALL),
bounds AS (
  SELECT level, lang, source, max(n) AS n, {_BOUNDS} FROM quartiles GROUP BY level, lang, source),
own AS (
  SELECT lang, source, CASE WHEN n >= {quality_rules.MIN_GROUP} THEN 0
      WHEN sum(n) OVER (PARTITION BY lang) >= {quality_rules.MIN_GROUP} THEN 1 ELSE 3 END AS use
  FROM bounds WHERE level = 0),
limits AS (
  SELECT own.lang, own.source, bounds.* EXCLUDE (level, lang, source, n) FROM own JOIN bounds ON level = use
    AND (CASE WHEN use < 3 THEN own.lang END) IS NOT DISTINCT FROM bounds.lang
    AND (CASE WHEN use < 1 THEN own.source END) IS NOT DISTINCT FROM bounds.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND {_PASSES}, false) AS kept
FROM rated LEFT JOIN limits ON rated.lang IS NOT DISTINCT FROM limits.lang
  AND rated.source IS NOT DISTINCT FROM limits.source"""

# Base 32 of a SHA-1: 40 hex digits, five of them to four digits of the base-32 alphabet.
_BASE32 = "translate(concat(" + ", ".join(
    f"to_base(CAST(concat('0x', substring(h, {i}, 5)) AS BIGINT), 32, 4)" for i in range(1, 41, 5)
) + "), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
_OP4 = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to FROM last"""

_OP5 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d),
windows AS (SELECT r, i, hash(array_to_string(w[i:i+34], ' ')) AS h FROM starts),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows WHERE h IN (FROM repeated)),
gone AS (SELECT r, list(p) AS ps FROM covered GROUP BY r)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
    list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON d.r = gone.r"""

_OP7 = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, list_filter(string_split(
    regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM texts),
s AS (
  SELECT kind, id, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
short AS (SELECT DISTINCT len(w) AS n FROM w WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4),
docs AS (
  SELECT id AS doc_id, shingle FROM s WHERE kind = 'd'
  UNION SELECT id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' ')))
  FROM w JOIN short ON kind = 'd' AND len(w) >= n),
items AS (SELECT DISTINCT id AS item_id, shingle FROM s WHERE kind = 'i'),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT doc_id, items.item_id, n AS n_shingles, count(*) AS n_found
FROM docs JOIN items USING (shingle) JOIN sizes ON items.item_id = sizes.item_id
GROUP BY doc_id, items.item_id, n HAVING count(*) * 100 >= n * 80"""

_OP12 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

# CRC-32 of a decimal id, bit by bit over its digits; 3988292384 is the reversed polynomial.
_CRC32 = """xor(4294967295, list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({id} AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
# A run holds five words in a row that come again one period later; islands of such places are runs.
_OP11 = f"""
WITH src AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, CAST({_CRC32.format(id="doc_id")} AS BIGINT) AS h
  FROM documents),
plan AS (
  SELECT *, (h // 10) % len(w) AS a FROM src),
d AS (
  SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0
    THEN list_transform(range(0, len(w)), lambda i: w[1 + CASE WHEN i < a THEN i
      ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM plan),
starts AS (SELECT r, len(w) AS n, w, unnest(range(0, len(w) - 4)) AS i FROM d),
fives AS (SELECT r, n, i, hash(w[i + 1 : i + 5]) AS k FROM starts),
again AS (
  SELECT x.r, y.i - x.i AS p, x.i FROM fives x JOIN fives y
  ON x.r = y.r AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM again),
stretches AS (
  SELECT r, p, min(i) AS s, max(i) + 5 - min(i) + p AS length FROM islands GROUP BY r, p, island),
runs AS (
  SELECT r, s, length, min(p) AS p FROM stretches WHERE length >= greatest(6, 4 * p) GROUP BY r, s, length),
listed AS (
  SELECT r, count(*) AS n_runs, sha256(string_agg(concat(s, ',', length, ',', p, chr(10)), '' ORDER BY s, p)) AS runs_sha256,
    max(struct_pack(length := length, s := -s, p := -p)) AS best FROM runs GROUP BY r),
gone AS (
  SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(s + p, s + length)) AS i FROM runs) x GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.length AS length, -best.p AS period,
  1000 * best.length // -best.p AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN listed ON listed.r = d.r LEFT JOIN gone ON gone.r = d.r"""
_OP13 = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, CAST({_CRC32.format(id="c")} AS BIGINT) % {conversation_trie.BRANCH} AS h
  FROM (SELECT DISTINCT c FROM t) x),
heads AS (
  SELECT ids.c, t.pos AS d, role, text FROM ids
  JOIN t ON t.c = ids.c - ids.c % {conversation_trie.FAMILY} AND t.pos <= ids.h),
begun AS (
  SELECT ids.c, any_value(h) AS h, count(d) AS n FROM ids LEFT JOIN heads ON heads.c = ids.c GROUP BY ids.c),
rebuilt AS (
  SELECT c, d, role, text FROM heads
  UNION ALL SELECT t.c, n + pos - h, role, text FROM t JOIN begun ON begun.c = t.c WHERE pos > h),
beginnings AS (
  SELECT c, d, octet_length(encode(text)) AS n_bytes,
    md5(string_agg(md5(concat(length(role), ':', role, text)), '') OVER (
      PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM ids),
steps AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS above FROM beginnings),
nodes AS (
  SELECT k, d, min(c) AS c, count(*) AS n, any_value(n_bytes) AS n_bytes, any_value(above) AS above
  FROM steps GROUP BY k, d),
families AS (SELECT above AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY ALL),
grown AS (
  SELECT nodes.*, coalesce(families.n, 0) AS n_children FROM nodes
  LEFT JOIN families ON families.k = nodes.k AND families.d = nodes.d),
subtrees AS (
  SELECT b.k, b.d, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves,
    CAST(sum((n - 1) * g.n_bytes) AS BIGINT) AS saved FROM grown g
  JOIN beginnings b ON b.c = g.c AND b.d <= g.d GROUP BY b.k, b.d),
lasts AS (SELECT c, max(d) AS d, arg_max(k, d) AS k FROM beginnings GROUP BY c),
ends AS (SELECT k, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM lasts GROUP BY k, d)
SELECT g.c AS conv_id, g.d AS depth, p.c AS parent_conv_id, g.n AS n_convs, g.n_children, n_leaves,
  saved AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM grown g JOIN subtrees s ON s.k = g.k AND s.d = g.d
LEFT JOIN ends ON ends.k = g.k AND ends.d = g.d
LEFT JOIN nodes p ON p.k = g.above AND p.d = g.d - 1"""

ORACLE_SQL = {
    "op1_quality_rules": _OP1,
    "op4_warc_packages": _OP4,
    "op5_substring_dedup": _OP5,
    "op7_benchmark_decontamination": _OP7,
    "op11_periodic_runs": _OP11,
    "op12_voronoi_topk": _OP12,
    "op13_conversation_trie": _OP13,
}
