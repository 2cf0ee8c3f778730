"""The queries of this subpackage, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_extract, licenses, line_dedup, merkle, packing, periodic, simhash, suffix_dedup, topk, toxicity, url_filter
from .shared import table

VOCABULARY = "byte_bpe_50k.json"
#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The list behind the Bloom filter: sites, as canonical keys.
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED = [f"{site}.example.{top}/" for site in LISTED_SITES for top in ("com", "net", "org")]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of its group of equal texts that stays: the largest doc_id. Texts are compared as they are; null is empty."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its fingerprint and the least doc_id that links of 3 bits or fewer reach. Texts without words have fingerprint zero."""
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the number and digest of its ids, and the digest of the text that these decode to. Null is empty and has no ids."""
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its main text; null and empty pages, and pages that are all boilerplate, have an empty one."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its host, path, the longest rule that fits and the verdict. Null URLs have an empty host and path and are allowed."""
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES, listed)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the digest of its normalised text, the license that this is, and the licenses of its lines."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for each query, whose vec_id is divisible by 100, over all rows; vectors that are null or not finite take no part."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its score and label, learned from labels that are not held out; empty texts are scored as texts without features."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    out = toxicity.score(docs, toxicity.learn(docs, labels))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with what is left of it, by digest, when runs of 50 words or 3 lines that an earlier place has are deleted."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_lines", "removed_words", "spans", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document with its place in a sequence of 1024 ids; null is empty and has the one id that ends every document."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def _crc(id_col: str):
    """Unsigned CRC-32 of an id as decimal text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its leaf, proof and roots; where 2 divides the CRC-32 of the id, the proof is tried on the text without its newlines. Null texts and ids are never tampered with."""
    text = F.when(_crc("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    same = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    out = merkle.verified(table(spark, sf_dir, "documents"), [*same, F.col("text")], [*same, text])
    return out.select("doc_id", "leaf", "subroot", "root", merkle.hashed(F.col("siblings")).alias("proof_sha256"), "folded_root", "verified")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with what is left of it, by digest, when all bytes within repeated strings of 200 bytes are removed. Null is empty."""
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _planted(docs: DataFrame) -> DataFrame:
    """docs with a periodic end in the text, where 10 divides the CRC-32 h of the id and there are n > 0 words: with g = h / 10, each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8)."""
    h, n, a, p = _crc("doc_id"), F.col("n"), F.col("a"), F.col("p")
    div, g = lambda x, y: F.call_function("div", x, y), F.call_function("div", h, F.lit(10))
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, periodic.words_of(F.col("text"))).alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + div(n - a, 3 + g % 8)).cast("int"))
    period = F.slice("words", a + 1, p)
    end = F.slice(F.flatten(F.array_repeat(period, (div(n - a, p) + 1).cast("int"))), F.lit(1), n - a)
    return docs.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("words", F.lit(1), a), end), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, some with a planted periodic end, with the number of its runs, the one of the greatest exponent, and digests of all runs and of what is left without them. Without runs the four columns of that one are null."""
    out = periodic.periodic_runs(_planted(table(spark, sf_dir, "documents")))
    # greater exponents first; of equal ones the run that starts first, then the smaller period, as in runs
    better = lambda x, y: F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int")
    tied = lambda x, y: F.when(better(x, y) != 0, better(x, y)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int"))
    best = F.get(F.array_sort("runs", tied), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that are left of all documents when toxic ones and copies are gone."""
    import corpus_pipeline  # which imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    ops = [op1_exact_dedup, op2_simhash, op3_bpe, op4_html, op5_url_filter, op6_licenses, op7_topk, op8_toxicity, op9_line_dedup, op10_packing, op11_merkle, op12_suffix_dedup, op13_periodic_runs]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


#: CRC-32 of the decimal text of doc_id: each byte, then eight shifts.
_CRC = """xor(list_reduce(flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i: [ascii((doc_id::VARCHAR)[i + 1])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)"""
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF, _SHOWN = ("sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")" for text in ("text", "text_2"))

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_LISTED_ROWS = ", ".join(f"('{k[:-1]}')" for k in LISTED)

ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_url_filter": rf"""
        WITH rules(verdict, h, p) AS (VALUES {_RULE_ROWS}), listed(site) AS (VALUES {_LISTED_ROWS}),
        cut AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                       regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        best AS (SELECT c.*, (SELECT max_by(r.h || r.p || ' ' || r.verdict, length(r.h || r.p)) FROM rules r
                              WHERE (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)) AS rule,
                        EXISTS (SELECT 1 FROM listed l WHERE c.host = l.site OR ends_with(c.host, '.' || l.site)) AS hit FROM cut c)
        SELECT page_id, host, path, split_part(rule, ' ', 1) AS rule,
               coalesce(split_part(rule, ' ', 2), CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict FROM best""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_merkle": f"""
        WITH RECURSIVE shown AS (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text_2 FROM documents),
        leaves AS (SELECT doc_id, source, {_LEAF} AS leaf, {_SHOWN} AS shown FROM shown),
        placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
        nodes(tree, level, pos, n, d) AS (SELECT tree, 0, pos, n, leaf FROM placed UNION ALL
            SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level + 1, pos // 3, (n + 2) // 3),
        subroots AS (SELECT tree AS pos, (SELECT count(DISTINCT tree) FROM placed) AS n, d FROM nodes WHERE n = 1),
        tops(level, pos, n, d) AS (SELECT 0, pos, n, d FROM subroots UNION ALL
            SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level + 1, pos // 3, (n + 2) // 3),
        runs AS (SELECT tree, level, pos // 3 AS run, string_agg(d, '' ORDER BY pos) AS whole, n FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n UNION ALL
            SELECT -1, level, pos // 3, string_agg(d, '' ORDER BY pos), n FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
        steps AS (SELECT doc_id, pos AS at, tree, 0 AS k, 0 AS level, shown AS d, '' AS proof FROM placed UNION ALL
            SELECT s.doc_id, CASE WHEN r.run IS NULL THEN s.tree ELSE s.at // 3 END, CASE WHEN r.run IS NULL THEN -1 ELSE s.tree END, s.k + 1, CASE WHEN r.run IS NULL THEN 0 ELSE s.level + 1 END,
                   CASE WHEN r.run IS NULL THEN s.d ELSE sha256(r.whole[:64 * (s.at % 3)] || s.d || r.whole[64 * (s.at % 3) + 65:]) END,
                   s.proof || CASE WHEN r.run IS NULL THEN '' ELSE r.whole[:64 * (s.at % 3)] || r.whole[64 * (s.at % 3) + 65:] END
            FROM steps s LEFT JOIN runs r ON r.tree = s.tree AND r.level = s.level AND r.run = s.at // 3 WHERE r.run IS NOT NULL OR s.tree >= 0),
        ends AS (SELECT doc_id, arg_max(d, k) AS folded_root, arg_max(proof, k) AS proof FROM steps GROUP BY doc_id)
        SELECT p.doc_id, p.leaf, s.d AS subroot, t.d AS root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = t.d AS verified
        FROM placed p JOIN ends e USING (doc_id) JOIN subroots s ON s.pos = p.tree JOIN tops t ON t.n = 1""",
    "op12_suffix_dedup": """
        WITH t AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
        w AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM t)),
        again AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
        new AS (SELECT *, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, 0))::INTEGER AS begins FROM again),
        numbered AS (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM new),
        spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 199 AS z FROM numbered GROUP BY doc_id, k),
        ends AS (SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) FROM t),
        kept AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a) + 1, 1) AS since FROM ends)
        SELECT doc_id, any_value(octet_length(b))::BIGINT AS n_bytes, sum(z - a + 1)::BIGINT AS n_removed, count(*) - 1 AS n_spans,
               sha256(unhex(string_agg(CASE WHEN since < a THEN hex(b[since:a - 1]) ELSE '' END, '' ORDER BY a))) AS kept_sha256
        FROM kept JOIN t USING (doc_id) GROUP BY doc_id""",
    "op13_periodic_runs": rf"""
        WITH cut AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {_CRC} AS h FROM documents),
        ends AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, 3 + (h // 10) % 8 AS reps FROM cut),
        docs AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // reps) END]) AS w FROM ends),
        grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 16], ' ') AS g FROM (SELECT *, unnest(range(n - 15)) AS i FROM docs WHERE n >= 24)),
        pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        parts AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
        stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM parts GROUP BY doc_id, q, k),
        runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
        own AS (SELECT doc_id, count(*) AS n_runs, list(struct_pack(start, length, period)) AS all_runs,
                       list(struct_pack(start, length, period) ORDER BY length / period DESC, start, period)[1] AS best,
                       string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length) // best.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(array_to_string(CASE WHEN n_runs IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: len(list_filter(all_runs, lambda r: i >= r.start + r.period AND i < r.start + r.length)) = 0), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
        FROM docs LEFT JOIN own USING (doc_id)""",
}
