"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import decontamination, hard_negatives, language_id, packing, periodic_runs, personal_data, quality_rules, simhash, substring, token_files, tool_calls, url_filters, warc
from cohortlab.llm.common import table, word_array

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "symbol_permille", "upper_permille", "dup_line_permille", "repeat_permille", "mean_word_centi")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    hit = decontamination.hit_count()
    return s.select("doc_id", F.col("__hit_words").alias("n_words"), hit.alias("n_hit"),
                    F.size("__hit_items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("__hit_items", ","), 256).alias("items_sha256"),
                    (hit > 0).alias("contaminated"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find(docs, personal_data.fit_model(docs))
    n = lambda k: F.size(F.filter("__base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in personal_data.KINDS[:4]],
                        F.sha2(personal_data.span_text(F.col("__base_spans")), 256).alias("base_sha256"),
                        personal_data.span_text(personal_data.all_spans()).alias("spans"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.read_records(warc.write_pages(table(spark, sf_dir, "pages")))
    return r.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    warc.page_of("refers_to").alias("refers_to"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit_model(docs.filter(F.col("doc_id").isNotNull() & ~out))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_langs"))


@query
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.conversation_calls(table(spark, sf_dir, "conversations"))
    schemas = tool_calls.schema_table(spark, tool_calls.CONVERSATION_SCHEMAS)
    return tool_calls.format_calls(calls, results, schemas)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(files)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(word_array(F.col("text")))
    docs = docs.withColumns({"n": n, "h": h, "g": g}).withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    docs = docs.withColumn("text", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), periodic_runs.cycle_words(
        F.col("text"), F.col("a"), period)).otherwise(F.col("text")))
    found = periodic_runs.periodic_runs(docs.select("doc_id", "text")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    # the greatest length first, then the smallest start and period
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", "n_runs", (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    label = F.when(v % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.integer_vectors(table(spark, sf_dir, "embeddings"), v, F.col("embedding"), label)
    return hard_negatives.hard_negatives(vectors, F.col("id") % 100 == 0)


@query
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages).select(
        "page_id", "host", "path", "rule", "verdict", "host_labelled", "host_blocked",
        (F.round("bad_bound", 6) + F.lit(0.0)).alias("bad_bound"))


# -- DuckDB SQL of the queries that it can express -------------------------------
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest"""

ORACLES["op6_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
     g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
     least AS (SELECT k, min(doc_id) AS first_id FROM g GROUP BY k),
     hit AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT g.doc_id, g.i FROM g JOIN least ON g.k = least.k
             WHERE g.doc_id > first_id), (SELECT unnest(range(0, 13)) AS j)),
     kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS s, count(*) AS n FROM t
              LEFT JOIN hit ON t.doc_id = hit.doc_id AND t.i = hit.i WHERE hit.i IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

_FOLDED = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

ORACLES["op9_decontamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark),
     bg AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
            FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
     dg AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
     m AS (SELECT doc_id, dg.n, i, item FROM dg JOIN bg ON dg.n = bg.n AND dg.k = bg.k),
     hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, (SELECT unnest(range(0, 10)) AS j) WHERE j < n GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS c, string_agg(item, ',' ORDER BY item) AS s
             FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(c, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""


def _quality_sql() -> str:
    q = quality_rules
    values = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, {s} AS v FROM sig WHERE NOT base_failed AND {s} IS NOT NULL"
                                for s in q.SIGNALS)

    def quartiles(keys: str) -> str:
        k = keys and keys + ", "
        return f"""SELECT {k}signal, min(low) FILTER (WHERE upto * 4 >= total) AS q1, min(low) FILTER (WHERE upto * 4 >= total * 3) AS q3,
                   max(total) AS total FROM (SELECT {k}signal, low, sum(n) OVER (PARTITION BY {k}signal ORDER BY low) AS upto,
                   sum(n) OVER (PARTITION BY {k}signal) AS total FROM (SELECT {k}signal, low, count(*) AS n FROM sk GROUP BY {k}signal, low))
                   GROUP BY {k}signal"""

    pick = lambda c: (f"CASE WHEN s.total >= {q.MIN_GROUP} THEN s.{c} WHEN l.total >= {q.MIN_GROUP} THEN l.{c} ELSE a.{c} END")
    res = "CASE s.signal " + " ".join(f"WHEN '{s}' THEN {r}" for s, (r, _) in q.SIGNALS.items()) + " END"
    two = ", ".join(f"'{s}'" for s, (_, t) in q.SIGNALS.items() if t)
    bad = " OR ".join(f"(signal = '{s}' AND ({s} > hi OR (signal IN ({two}) AND {s} < lo)))" for s in q.SIGNALS)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
     g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS k
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
     r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM
           (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
           (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
     ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
            WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
     c AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                  CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_upper, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_lines,
                  CAST(coalesce(ln.n - u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
           FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN ln ON d.doc_id = ln.doc_id),
     sig AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
                    n_symbols * 1000 // greatest(word_chars, 1) AS symbol_permille, n_upper * 1000 // greatest(word_chars, 1) AS upper_permille,
                    n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_permille,
                    n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_permille,
                    CASE WHEN n_words >= {q.MEAN_MIN_WORDS} THEN word_chars * 100 // n_words END AS mean_word_centi FROM c),
     sk AS (SELECT lang, source, signal, (v // p) * p AS low FROM
            (SELECT *, CAST(pow(2, greatest(length(bin(v)) - {q.SKETCH_BITS}, 0)) AS BIGINT) AS p FROM ({values}))),
     qs AS ({quartiles("lang, source")}), ql AS ({quartiles("lang")}), qa AS ({quartiles("")}),
     f AS (SELECT lang, source, signal, q1 - greatest(q3 - q1, res) * {q.FENCE} AS lo, q3 + greatest(q3 - q1, res) * {q.FENCE} AS hi
           FROM (SELECT s.lang, s.source, s.signal, {pick("q1")} AS q1, {pick("q3")} AS q3, {res} AS res FROM qs s
                 JOIN ql l ON s.lang IS NOT DISTINCT FROM l.lang AND s.signal = l.signal JOIN qa a ON s.signal = a.signal)),
     o AS (SELECT DISTINCT doc_id FROM sig JOIN f ON sig.lang IS NOT DISTINCT FROM f.lang AND sig.source IS NOT DISTINCT FROM f.source
           WHERE {bad})
SELECT sig.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND o.doc_id IS NULL AS kept, symbol_permille, upper_permille, dup_line_permille, repeat_permille, mean_word_centi
FROM sig LEFT JOIN o ON sig.doc_id = o.doc_id"""


ORACLES["op1_quality_rules"] = _quality_sql()


def _url_sql() -> str:
    u = url_filters
    fits = lambda r: (lambda h, slash, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + p}')")(*r.partition("/"))
    ranked = sorted(u.RULES, key=lambda r: (-len(r[0]), r[0]))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[i]}'" for r in ranked) + " END"
    second = ", ".join(f"'{x}'" for x in u.SECOND_LEVEL)
    rho = lambda p: (f"least(greatest(coalesce(sum((bad - n * {p}) * (bad - n * {p}) - n * {p} * (1 - {p}))"  # noqa: E731
                     f" / nullif(sum(n * (n - 1) * {p} * (1 - {p})), 0), {u.RHO[1]}), {u.RHO[0]}), {u.RHO[1]})")
    m = lambda p, source: f"SELECT (1 - rho) / rho AS m FROM (SELECT {rho(p)} AS rho FROM {source})"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
     c AS (SELECT page_id, translate(h, '{u.UPPER}', '{u.LOWER}') AS host,
                  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
     d AS (SELECT *, {case(0)} AS rule, {case(1)} AS says FROM c),
     e AS (SELECT host, count(says) AS n, count(*) FILTER (WHERE says = 'block') AS bad,
                  regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS bare
           FROM d GROUP BY host),
     f AS (SELECT *, string_split(bare, '.') AS l, len(string_split(bare, '.')) AS k FROM e),
     g AS (SELECT *, CASE WHEN k < 2 OR regexp_matches(bare, '^[0-9.]*$') THEN k
                          WHEN k > 2 AND length(l[-1]) = 2 AND l[-2] IN ({second}) THEN 2 ELSE 1 END AS w FROM f),
     hosts AS (SELECT host, n, bad, array_to_string(l[greatest(k - w + 1, 1):k], '.') AS suffix,
                      array_to_string(l[greatest(k - w, 1):k], '.') AS domain FROM g),
     t AS (SELECT coalesce(sum(n), 0) AS tn, coalesce(sum(bad), 0) AS tb FROM hosts),
     dn AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
     sx AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dn GROUP BY 1),
     ms AS ({m("r", "(SELECT *, (tb - bad + 0.5e0) / (tn - n + 1) AS r FROM sx, t)")}),
     d1 AS (SELECT dn.*, sx.n AS sn, sx.bad AS sb, (tb - dn.bad + 0.5e0) / (tn - dn.n + 1) AS r FROM dn JOIN sx USING (suffix), t),
     md AS ({m("s", "(SELECT *, (m * r + sb - bad) / (m + sn - n) AS s FROM d1, ms)")}),
     h1 AS (SELECT h.*, sx.n AS sn, sx.bad AS sb, dn.n AS dn, dn.bad AS db, (tb - h.bad + 0.5e0) / (tn - h.n + 1) AS r
            FROM hosts h JOIN dn USING (domain) JOIN sx ON h.suffix = sx.suffix, t),
     h2 AS (SELECT h1.*, (ms.m * r + sb - bad) / (ms.m + sn - n) AS s FROM h1, ms),
     h3 AS (SELECT h2.*, (md.m * s + db - bad) / (md.m + dn - n) AS p FROM h2, md),
     mh AS ({m("p", "h3")}),
     h4 AS (SELECT host, n, bad, pow(sin(greatest(asin(sqrt((m * p + bad) / (m + n))) - {u.Z} / (2 * sqrt(m + n + 1)), 0)), 2) AS bound
            FROM h3, mh)
SELECT page_id, d.host, path, rule, coalesce(says, CASE WHEN bound > {u.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
       n AS host_labelled, bad AS host_blocked, round(bound, 6) + 0.0 AS bad_bound
FROM d JOIN h4 ON d.host = h4.host"""


ORACLES["op13_url_filters"] = _url_sql()

ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
           FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
     p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5"""
