"""Quality rules with adaptive thresholds (DataFrame functions only).

Every document gets integer signals.  A quantile sketch of each signal is kept per
(language, source): counts of log-linear buckets with ``SKETCH_BITS`` leading bits,
exact below ``2**SKETCH_BITS`` and within a factor ``1 + 2**(1 - SKETCH_BITS)``
above.  Such sketches merge by adding counts, so Spark builds them with partial
aggregates, and the same counts summed over sources (or everything) give the
sketch of a language (or the corpus).  The fences ``q1 - 3 * spread`` and
``q3 + 3 * spread`` of the finest group with at least ``MIN_GROUP`` documents
replace fixed cutoffs; ``spread`` is the interquartile range, at least the
signal's resolution.  A second, joined pass applies the fences.

Defined results: a NULL text has no words (and so fails the base rules); NULL
language or source is a group of its own; repeated rows are judged alike; an empty
table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import SPACES, row_key, stage, word_array

SKETCH_BITS = 7
MIN_GROUP = 200
#: documents shorter than this have no mean word length worth judging
MEAN_MIN_WORDS = 50
FENCE = 3
SALTS = 64
#: signal: (resolution of the spread, judged below the lower fence too)
SIGNALS = {
    "symbol_permille": (10, False),
    "upper_permille": (60, False),
    "dup_line_permille": (120, False),
    "repeat_permille": (65, False),
    "mean_word_centi": (60, True),
}


def _repeats(words: str, hashes: str, wins: str) -> Column:
    """Words inside five-word windows that occur twice or more in the document.

    Equal windows have equal hashes, so a document without a repeated hash has
    none; the others compare the windows' words.
    """
    n = F.size(words)
    text = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(5)])
    by_text = F.array_sort(F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.struct(text(i).alias("s"), i.alias("i"))))
    again = lambda s: F.transform(
        F.filter(F.transform(s, lambda x, k: F.struct(
            x["i"].alias("i"),
            ((F.try_element_at(s, k + 2)["s"] == x["s"]) | ((k > 0) & (F.get(s, k - 1)["s"] == x["s"]))).alias("d"))),
            lambda x: F.coalesce(x["d"], F.lit(False))), lambda x: x["i"])
    return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.array().cast("array<int>")).otherwise(
        F.sort_array(_let(by_text, again)))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
            source: str = "source") -> DataFrame:
    """One row per input row: ids, groups, counts and integer signals (a written table).

    It is written because filters on the counts would otherwise be pushed below the
    word arrays, which would then be computed again for every use.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
                    row_key(F.col(text), F.col(lang), F.col(source)).alias("row_key"),
                    F.col(text).alias("t"), word_array(F.col(text)).alias("w"))
    # the line array is split from the text once; its distinct size gives the copies
    d = d.select("*", F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"),
                 F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    at = lambda i, j: F.get(F.col("h"), i + j)
    d = d.select(
        "doc_id", "lang", "source", "row_key", "w", "h",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("t", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.regexp_count("t", F.lit("[A-Z]")), F.lit(0)).cast("long").alias("n_upper"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 5, F.transform(
            F.sequence(F.lit(0), F.size("w") - 5),
            lambda i: F.xxhash64(i * 0, at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4))))
        .otherwise(F.array().cast("array<bigint>")).alias("wins"))
    d = d.select("doc_id", "lang", "source", "row_key", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines",
                 "n_dup_lines", _repeats("w", "h", "wins").alias("p"))
    covered = F.aggregate(
        F.col("p"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n")),
        lambda a: a["n"])
    d = d.select(*[c for c in d.columns if c != "p"], covered.alias("n_repeat_words"))
    per = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    return stage(d.select(
        "doc_id", "lang", "source", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)).alias("base_failed"),
        per("n_symbols", "word_chars").alias("symbol_permille"),
        per("n_upper", "word_chars").alias("upper_permille"),
        per("n_dup_lines", "n_lines").alias("dup_line_permille"),
        per("n_repeat_words", "n_words").alias("repeat_permille"),
        F.when(F.col("n_words") >= MEAN_MIN_WORDS, F.floor(F.col("word_chars") * 100 / F.col("n_words")).cast("long"))
        .alias("mean_word_centi")), "quality-signals")


def bucket_low(v: Column) -> Column:
    """Lower end of a value's sketch bucket: its leading ``SKETCH_BITS`` bits."""
    shift = F.greatest(F.length(F.bin(v)) - SKETCH_BITS, F.lit(0))
    scale = F.pow(F.lit(2.0), shift).cast("long")
    return (F.floor(v / scale) * scale).cast("long")


def sketches(sig: DataFrame) -> DataFrame:
    """Bucket counts ``(lang, source, signal, low, n)`` of documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in SIGNALS]))
    return (sig.filter(~F.col("base_failed")).select("lang", "source", pairs.alias("x"))
            .select("lang", "source", F.col("x.signal").alias("signal"), F.col("x.v").alias("v"))
            .filter("v IS NOT NULL")
            .groupBy("lang", "source", "signal", bucket_low(F.col("v")).alias("low"))
            .agg(F.count("*").alias("n")))


def fences(sk: DataFrame) -> DataFrame:
    """``(lang, source, signal, lo, hi)`` per group, from the finest sketch that is large enough."""
    from pyspark.sql import Window

    def quartiles(keys: list[str], name: str) -> DataFrame:
        merged = sk.groupBy(*keys, "signal", "low").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "signal")
        run = F.sum("n").over(w.orderBy("low").rowsBetween(Window.unboundedPreceding, 0))
        c = merged.select(*keys, "signal", "low", run.alias("upto"), F.sum("n").over(w).alias("total"))
        q = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("low")))
        return (c.groupBy(*keys, "signal").agg(q(1).alias("q1"), q(3).alias("q3"), F.max("total").alias("total"))
                .select(*[F.col(k).alias(f"{name}_{k}") for k in [*keys, "signal"]],
                        F.struct("q1", "q3", "total").alias(name)))

    by_source, by_lang, by_all = quartiles(["lang", "source"], "s"), quartiles(["lang"], "l"), quartiles([], "a")
    j = (by_source
         .join(by_lang, F.col("s_lang").eqNullSafe(F.col("l_lang")) & (F.col("s_signal") == F.col("l_signal")))
         .join(by_all, F.col("s_signal") == F.col("a_signal")))
    big = lambda x: F.col(f"{x}.total") >= MIN_GROUP
    pick = F.when(big("s"), F.col("s")).when(big("l"), F.col("l")).otherwise(F.col("a"))
    res = F.create_map(*[x for s, (r, _) in SIGNALS.items() for x in (F.lit(s), F.lit(r))])[F.col("s_signal")]
    two = F.create_map(*[x for s, (_, t) in SIGNALS.items() for x in (F.lit(s), F.lit(t))])[F.col("s_signal")]
    j = j.select(F.col("s_lang").alias("f_lang"), F.col("s_source").alias("f_source"), F.col("s_signal").alias("signal"),
                 pick.alias("q"), res.alias("res"), two.alias("two"))
    spread = F.greatest(F.col("q.q3") - F.col("q.q1"), F.col("res"))
    return j.select("f_lang", "f_source", "signal",
                    F.when(F.col("two"), F.col("q.q1") - spread * FENCE).alias("lo"),
                    (F.col("q.q3") + spread * FENCE).alias("hi"))


def judge(sig: DataFrame, fence_rows: DataFrame) -> DataFrame:
    """Joined filtering: every document meets the fences of its group.

    The fences are one row per group; rows of a hot group are salted over
    ``SALTS`` copies of its fences.  A group without fences (all its documents
    failed the base rules) has no verdict but the base one.
    """
    ends = lambda s, e: F.max(F.when(F.col("signal") == s, F.col(e))).alias(f"{s}_{e}")
    wide = (fence_rows.groupBy("f_lang", "f_source").agg(*[ends(s, e) for s in SIGNALS for e in ("lo", "hi")])
            .withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = sig.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    j = salted.join(wide, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
                    & (F.col("salt") == F.col("f_salt")), "left")
    bad = F.lit(False)
    for s, (_, two) in SIGNALS.items():
        out = F.col(s) > F.col(f"{s}_hi")
        bad = bad | F.coalesce((out | (F.col(s) < F.col(f"{s}_lo"))) if two else out, F.lit(False))
    return j.select(*sig.columns, bad.alias("outlier")).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))


def quality_rules(docs: DataFrame, **cols) -> DataFrame:
    """Verdict per document (see the module); signals and sketches are written tables."""
    sig = signals(docs, **cols)
    sk = stage(sketches(sig), "quality-sketches")
    return judge(sig, stage(fences(sk), "quality-fences"))


def keep_documents(docs: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                   source: str = "source") -> DataFrame:
    """Rows of ``docs`` with a kept verdict; all columns stay.

    A verdict follows from a row's text and group, so a row is found by its id and
    ``row_key``: rows that share an id, or have none, are judged each for itself.
    """
    good = verdicts.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("row_key").alias("__kept_key"))
    same = docs[doc_id].eqNullSafe(F.col("__kept_id")) & (
        row_key(docs[text], docs[lang], docs[source]) == F.col("__kept_key"))
    return docs.join(good, same, "left_semi")
