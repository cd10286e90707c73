"""One query for each operator of this subpackage, over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from strataspark.llm import ann, bpe_transducer, chat, decontaminate, license_scan, line_dedup, periodic_runs, prefix_trie, quality, sentencepiece_viterbi, toxicity, warc
from strataspark.llm.near_dedup import near_duplicates
from strataspark.scratch import materialise, new_path

#: Where the vocabulary of op4 lies; a parameter of the operator.
VOCABULARY = os.environ.get("STRATASPARK_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
#: The same for op11.
WORD_VOCABULARY = os.environ.get("STRATASPARK_WORD_VOCABULARY", "/opt/tokenizers/word_bpe_49k.json")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT node, b FROM reach JOIN edges ON a = seen
), least_of AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least_of ON node = d.doc_id
"""


def op2_quality(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, quality.labelled_sample(docs, quality.training_labels(labels)))
    return quality.score_quality(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_ann(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors), vectors.where("vec_id % 20 = 0"))


def op4_sentencepiece(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_viterbi.with_tokens(docs, VOCABULARY).select("doc_id", "n_tokens", "round_trip", "token_ids")


def op5_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), firsts AS (
  SELECT line, min({'id': doc_id, 'pos': pos}) AS f, length(line) AS n FROM lines WHERE line <> '' GROUP BY line
), close AS (  -- levenshtein counts bytes: another character may be one of four
  SELECT x.line, x.n, y.line AS before, y.n AS bn, levenshtein(x.line, y.line) AS d
  FROM firsts x JOIN firsts y ON y.n IN (x.n - 1, x.n, x.n + 1) AND y.f < x.f WHERE levenshtein(x.line, y.line) <= 4
), cut AS (SELECT *, unnest(range(greatest(n, bn))) AS k FROM close WHERE d > 1
), near AS (
  SELECT line FROM close WHERE d = 1
  UNION SELECT line FROM cut WHERE CASE WHEN n >= bn THEN left(line, k) || substring(line, k + 2) ELSE line END = CASE WHEN n <= bn THEN left(before, k) || substring(before, k + 2) ELSE before END
), marked AS (
  SELECT l.*, coalesce(f <> {'id': doc_id, 'pos': pos}, false) OR near.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN firsts USING (line) LEFT JOIN near ON near.line = l.line
)
SELECT d.doc_id, coalesce(count(pos), 0) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') END AS text
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, d.text
"""


def op6_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(toxicity.labelled_sample(docs, toxicity.training_labels(labels)))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.transform("offending", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"),
    )


def op9_warc(spark, sf_dir):
    folder = new_path(spark, "archives")
    files = materialise(warc.write_monolithic(warc.plan_records(_table(spark, sf_dir, "pages")), f"{folder}/crawl"), "crawl-files")
    index = materialise(warc.normalise(files, f"{folder}/records"), "offset-index")
    read, revisit = warc.read_records(index), F.col("warc_type") == "revisit"
    number = r"<urn:page:(-?\d+)>"
    return read.select(
        F.regexp_extract("record_id", number, 1).cast("long").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("stated_digest", ":", -1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.expr(r"try_cast(regexp_extract(refers_to, '<urn:page:(-?[0-9]+)>', 1) as long)").alias("refers_to"),
    )


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages WHERE page_id IS NOT NULL),
t AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN t USING (d)
"""


def op10_chat_format(spark, sf_dir):
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


_NAMED = "role"
for _char, _code in chat.NAME_ESCAPES:
    _NAMED = f"replace({_NAMED}, chr({ord(_char)}), '{_code}')"
OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role AS speaker, text,
    replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body,
    CASE WHEN role = 'system' THEN 'system' ELSE 'user' || coalesce(' name=' || NAMED, '') END AS named
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker IS NOT NULL AND speaker <> 'system'
), made AS (
  SELECT conv_id, perspective, turn, speaker, text, body, coalesce(speaker = perspective, false) AS trained,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' ELSE named END || chr(10) AS head
  FROM rows JOIN views USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker NULLS FIRST, text NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM made
)
SELECT conv_id, perspective, turn, speaker, head || body || chr(10) AS segment, CAST(start AS BIGINT) AS start, CAST(start + length(head) + length(body) + 1 AS BIGINT) AS "end", trained,
  CASE WHEN trained THEN CAST(start + length(head) AS BIGINT) END AS train_start, CASE WHEN trained THEN CAST(start + length(head) + length(body) AS BIGINT) END AS train_end
FROM placed
""".replace("NAMED", _NAMED)


def op11_bpe_transducer(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return bpe_transducer.with_bpe(docs, WORD_VOCABULARY).select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _with_repeats(docs):
    """The contract's texts: of one document in ten the words from some place on repeat a piece of themselves."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("words")
    words = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(periodic_runs.WORD), F.lit(0))))
    cut = words.withColumn("a", F.when(n > 0, F.pmod(g, n))).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", source(i).cast("int"))), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.with_runs(_with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = periodic_runs.strongest()
    listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), F.concat(x["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The unsigned crc32 of decimal numbers in SQL: a table of 256 remainders by the polynomial's rule, then a step for each digit.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS t)"


def crc32_sql(number: str) -> str:
    """SQL for the crc32 of a number's decimal text, where ``crc`` of :data:`CRC_TABLE` is joined."""
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {digits}), lambda c, d: xor(t[(xor(c, d) & 255) + 1], c >> 8)))"


OP12_SQL = rf"""
WITH {CRC_TABLE}, texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w0, {crc32_sql("doc_id")} AS h FROM documents, crc
), cuts AS (SELECT *, len(w0) AS n, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM texts
), pieces AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cuts
), docs AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM pieces
), places AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs
), grams AS (
  SELECT doc_id, n, i, hash(list_slice(w, i + 1, i + 8)) AS g FROM (SELECT doc_id, n, w, unnest(range(n - 7)) AS i FROM docs WHERE n >= 24)
), lags AS (
  SELECT DISTINCT x.doc_id, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n WHERE x.i % 8 = 0
), same AS (
  SELECT doc_id, q, x.i, x.i - row_number() OVER (PARTITION BY doc_id, q ORDER BY x.i) AS island
  FROM lags JOIN places x USING (doc_id) JOIN places y ON y.doc_id = lags.doc_id AND y.i = x.i + q AND y.word = x.word
), long AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) AS r FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM places p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.i = p.i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(r.len AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * r.len // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def _with_shared_starts(turns):
    """The contract's conversations: each one's first h turns are those of the conversation whose number is the next lower multiple of 5, h being crc32 mod 9. Gives turns and members."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    heads = turns.where("pos <= 8 and conv_id % 5 = 0").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("t"))
    members = turns.groupBy("conv_id").agg(F.lit(1)).select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"))
    members = materialise(members.join(heads, "base", "left").select("conv_id", "h", F.coalesce(F.slice("t", F.lit(1), F.col("h")), F.array().cast(heads.schema["t"].dataType)).alias("t")), "starts")
    start = members.select("conv_id", F.inline("t"))
    own = turns.join(members.select("conv_id", "h", F.size("t").alias("k")), "conv_id").where("pos > h")
    return start.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "n_bytes")), members.select("conv_id")


def op13_prefix_trie(spark, sf_dir):
    turns = materialise(prefix_trie.number_turns(_table(spark, sf_dir, "conversations")), "numbered")
    return prefix_trie.prefix_trie(*_with_shared_starts(turns))


OP13_SQL = f"""
WITH {CRC_TABLE}, numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY pos) AS l, list(octet_length(encode(text)) ORDER BY pos) AS b, {crc32_sql("conv_id")} % 9 AS h FROM numbered, crc GROUP BY conv_id, t
), made AS (
  SELECT w.conv_id AS c, list_concat(coalesce(list_slice(x.l, 1, w.h), []), list_slice(w.l, w.h + 1, len(w.l))) AS l, list_concat(coalesce(list_slice(x.b, 1, w.h), []), list_slice(w.b, w.h + 1, len(w.b))) AS b
  FROM whole w LEFT JOIN whole x ON x.conv_id = w.conv_id - w.conv_id % 5
), prefixes AS (SELECT c, b, len(l) AS n, list_slice(l, 1, d) AS p, d FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM made)
), nodes AS (
  SELECT p, d, min(c) AS c, count(*) AS n, coalesce(any_value(b[d]), 0) AS bytes, coalesce(string_agg(c, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM prefixes GROUP BY p, d
), kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1
), up AS (SELECT list_slice(x.p, 1, e) AS p, (x.n - 1) * bytes AS saved, k IS NULL AS leaf FROM (SELECT *, unnest(range(d + 1)) AS e FROM nodes LEFT JOIN kids USING (p)) x
), sums AS (SELECT p, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM up GROUP BY p)
SELECT CAST(x.c AS BIGINT) AS conv_id, CAST(x.d AS BIGINT) AS depth, CAST(y.c AS BIGINT) AS parent_conv_id, x.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x LEFT JOIN nodes y ON y.d = x.d - 1 AND y.p = list_slice(x.p, 1, x.d - 1) LEFT JOIN kids ON kids.p = x.p JOIN sums ON sums.p = x.p
"""


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality, op3_ann, op4_sentencepiece, op5_line_dedup, op6_license_scan, op7_decontaminate, op8_toxicity, op9_warc, op10_chat_format, op11_bpe_transducer, op12_periodic_runs, op13_prefix_trie)}
ORACLES = {"op1_minhash_near_dedup": OP1_SQL, "op5_line_dedup": OP5_SQL, "op9_warc": OP9_SQL, "op10_chat_format": OP10_SQL, "op12_periodic_runs": OP12_SQL, "op13_prefix_trie": OP13_SQL}
