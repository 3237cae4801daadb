"""Registered queries of the corpus operators: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, exact, lines, minhash, mixing, packing, ranked, rules, sharding, warc, whiten, wordpiece


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf, "documents"))


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf, "documents"), bucket_entries=512)


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    manifest, folder = warc.archive(table(spark, sf, "pages"))
    return warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return wordpiece.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))


SHARD_BYTES = 1 << 20


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"), SHARD_BYTES)


# target weights of the registered mix
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}, "source": {"src0": 2}}


def mix_domain() -> Column:
    """Domain of a document, from the number at the end of its source."""
    n = F.regexp_extract("source", r"(\d+)$", 1)
    return F.when(n == "", "other").otherwise(F.element_at(F.array(*map(F.lit, ("web", "books", "code"))), (F.try_to_number(n, F.lit("999999999")) % 3 + 1).cast("int")))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = mixing.mix(docs, weights=MIX_WEIGHTS, domain=mix_domain(), share=0.8, max_epochs=3, seed=17)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"))


def _mix_sql(share: float, max_epochs: int, seed: int) -> str:
    """The mix in plain SQL: one level of sharing after another, then each leaf's order by window."""
    def weight(level: str) -> str:
        return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items()) + " ELSE 1 END::DOUBLE"

    def shared(name: str, keys: list[str], level: str, parent: str) -> str:
        part = f"PARTITION BY {', '.join(keys)}" if keys else ""
        rows = f"({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        at = ", ".join([*keys, level])
        source = f"(SELECT {at}, sum(cap) AS cap, {weight(level)} AS w FROM leaves GROUP BY ALL) n " + (
            f"JOIN {parent} p USING ({', '.join(keys)})" if keys else f"CROSS JOIN {parent} p")
        return f"""
{name} AS (SELECT {at}, greatest(0, least(cap, floor(max(rate) OVER ({part}) * w)))::BIGINT AS budget FROM (
  SELECT *, (budget - coalesce(sum(cap) OVER {rows}, 0)) / (sum(w) OVER ({part}) - coalesce(sum(w) OVER {rows}, 0)) AS rate FROM {source}))"""

    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
  CASE WHEN regexp_extract(source, '(\d+)$', 1) = '' THEN 'other' ELSE (['web', 'books', 'code'])[regexp_extract(source, '(\d+)$', 1)::BIGINT % 3 + 1] END AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {max_epochs} AS cap FROM d GROUP BY ALL),
root AS (SELECT floor(sum(tokens) * {share}::DOUBLE)::BIGINT AS budget FROM leaves),{shared("b1", [], "domain", "root")},{
        shared("b2", ["domain"], "lang", "b1")},{shared("b3", ["domain", "lang"], "source", "b2")},
l AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM leaves JOIN b3 USING (domain, lang, source) WHERE tokens > 0),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || (epochs + 1) || ':' || doc_id), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before FROM d JOIN l USING (domain, lang, source) WHERE n_tokens > 0),
c AS (SELECT *, epochs + CASE WHEN before < rest AND 2 * before + n_tokens <= 2 * rest THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n_tokens, unnest(range(1, (copies + 1)::BIGINT)) AS epoch FROM c"""


def op10_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return classifier.classify(docs, classifier.train_on(docs, table(spark, sf, "labels")))


def op11_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(table(spark, sf, "documents"), ranks, pattern), ranks, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten.whiten(table(spark, sf, "embeddings"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_classifier": op10_classifier,
    "op11_bpe": op11_bpe,
    "op12_ranked_search": op12_ranked_search,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op4_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)""",
    # links between classes of equal shingle sets; least id reachable, by recursion
    "op2_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
                              ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
      FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN k ON k.doc_id = w.doc_id""",
    "op9_mixing": _mix_sql(share=0.8, max_epochs=3, seed=17),
    # lines cut at sentence ends; a later window covers its three units, less those its first occurrence covers itself
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, i, string_split(regexp_replace(ls[i], '([.!?]["'')\]]*[ \t]+)([^ \t\r\x0b\x0c])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS cut
      FROM l, unnest(range(1, len(ls) + 1)) AS x(i)),
u AS (SELECT doc_id, i, unnest(cut) AS unit, generate_subscripts(cut, 1) AS c FROM p),
w AS (SELECT doc_id, i, c, trim(unit, ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i, c) - 1 AS j
      FROM u WHERE regexp_matches(unit, '[^\x20\x09-\x0D]')),
v AS (SELECT doc_id, j, t AS a, lead(t) OVER d AS b, lead(t, 2) OVER d AS c, count(*) OVER (PARTITION BY doc_id) AS m FROM w
      WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
t AS (SELECT doc_id, j AS k, a, b, c FROM v WHERE c IS NOT NULL OR m < 3 AND j = 0),
f AS (SELECT *, first_value(doc_id) OVER o AS f_doc, first_value(k) OVER o AS f_k FROM t WINDOW o AS (PARTITION BY a, b, c ORDER BY doc_id, k)),
g AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = f_doc THEN greatest(k, f_k + 3) ELSE k END, k + 3)) AS j
      FROM f WHERE NOT (doc_id = f_doc AND k = f_k)),
r AS (SELECT doc_id, w.i, w.c FROM g JOIN w USING (doc_id, j)),
n AS (SELECT doc_id, count(DISTINCT i) AS n_lines, count(*) AS n_units FROM w GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id),
y AS (SELECT doc_id, i, string_agg(unit, '' ORDER BY c) AS line FROM u ANTI JOIN r USING (doc_id, i, c) GROUP BY doc_id, i),
x AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM y GROUP BY doc_id)
SELECT l.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text
FROM l LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS keep_id FROM p GROUP BY h),
d AS (SELECT page_id, keep_id, strlen(h) AS n, sha1(h) AS x FROM p JOIN k USING (h)),
b AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(x, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1, 1)) AS c FROM d)
SELECT page_id, n AS payload_bytes, array_to_string(c, '') AS payload_digest, CASE WHEN page_id = keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep_id THEN keep_id END AS refers_to FROM b""",
    # every document of every item's terms scored, then ranked
    "op12_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN c GROUP BY t),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM p JOIN w USING (t) JOIN q USING (t) CROSS JOIN c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""",
    # the shortest md5 prefix whose rows fit
    "op8_sharding": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 10))::BIGINT AS key FROM documents),
b(depth) AS (SELECT 0 UNION ALL SELECT depth + 1 FROM b WHERE depth < 40),
s AS (SELECT depth, key >> (40 - depth) AS prefix, sum(n_bytes) AS size FROM d CROSS JOIN b GROUP BY ALL),
f AS (SELECT doc_id, n_bytes, min(b.depth) FILTER (size <= {SHARD_BYTES}) AS depth, key FROM d CROSS JOIN b JOIN s ON s.depth = b.depth AND s.prefix = d.key >> (40 - b.depth)
      GROUP BY doc_id, n_bytes, key)
SELECT doc_id, n_bytes, depth::BIGINT AS shard_depth, key >> (40 - depth) AS shard_prefix FROM f""",
}
