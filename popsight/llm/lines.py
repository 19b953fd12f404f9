"""Line dedup by winnowing over line hashes.

The lines of a document that hold a word are numbered by the words before
them. A gram is the shortest run of whole lines from some line on that has at
least ``gram_words`` words; a passage is the shortest run with at least
``run_words``. Each passage selects the smallest gram hash inside it as its
fingerprint (winnowing), so every passage that occurs twice has the same
fingerprint both times: guaranteed, not just likely.

Fingerprints are joined over the corpus; only those that occur at several
positions go on. From such an anchor the match is extended both ways: all
passages that selected it are compared with the first place (doc_id, text,
line) where they occur, and every later occurrence is marked. Overlapping
marked passages grow together to maximal runs, which are deleted; first
occurrences stay. So a line goes if and only if it lies in a run of at least
``run_words`` words of whole lines that occurred earlier.

Only DataFrame functions. Nothing pairs the members of a group: groups
are reduced to their first place with map-side combining, and that place is
joined back, where Spark can split a passage that a third of all documents share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import q, stored, table, whole_row

RUN_WORDS, GRAM_WORDS = 50, 25


def passages(docs: DataFrame, doc_id: str, text: str, run_words: int, gram_words: int) -> DataFrame:
    """One row per place of a selected fingerprint: its hash, its place and the
    passages that selected it (hash, first and last line)."""
    lines = (docs.select(F.col(q(doc_id)).cast("long").alias("d"), F.xxhash64(F.col(q(text))).alias("t"),
                         F.posexplode(F.split(F.col(q(text)), "\n")).alias("p", "line"))
             .select("d", "t", "p", F.xxhash64("line").alias("h"),
                     F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))
             .filter("w > 0")
             .groupBy("d", "t", "p").agg(F.first("h").alias("h"), F.first("w").alias("w")))   # equal rows are one document
    doc = Window.partitionBy("d", "t")
    s = F.sum("w").over(doc.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    at = lines.withColumn("s", F.coalesce(s, F.lit(0)).cast("int"))
    gram = doc.orderBy("s").rangeBetween(0, gram_words - 1)
    run = doc.orderBy("s").rangeBetween(0, run_words - 1)
    at = at.select(
        "d", "t", "p", "s",
        F.xxhash64(F.collect_list("h").over(gram)).alias("g"), F.sum("w").over(gram).cast("int").alias("gw"),
        F.xxhash64(F.collect_list("h").over(run)).alias("r"), F.sum("w").over(run).cast("int").alias("rw"),
        F.max("p").over(run).alias("last"))
    grams = F.collect_list(F.struct("g", "p", "s", "gw")).over(run)
    inside = F.filter(grams, lambda x: (x["s"] + x["gw"] <= F.col("s") + F.col("rw")) & (x["gw"] >= gram_words))
    picked = (at.withColumn("f", F.array_min(F.transform(inside, lambda x: F.struct(x["g"].alias("g"), x["p"].alias("p")))))
              .filter(F.col("rw") >= run_words))
    return picked.groupBy("d", "t", F.col("f.p").alias("fp"), F.col("f.g").alias("f")).agg(
        F.collect_list(F.struct("r", "p", "last")).alias("runs"))      # at most run_words passages


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """Spans (d, t, spans): for each document (doc_id and text hash) with later
    occurrences the lines to delete as an array of (first, last), from 0."""
    if not 1 <= gram_words <= run_words:
        raise ValueError("gram_words must be between 1 and run_words")
    picked = stored(passages(docs, doc_id, text, run_words, gram_words), "passages")
    place = F.struct("d", "t", "fp")
    twice = (picked.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("b"))
             .filter(~F.col("a").eqNullSafe(F.col("b"))).select("f"))
    runs = stored(picked.join(twice, "f").select("d", "t", F.explode("runs").alias("x"))
                  .select("d", "t", "x.r", "x.p", "x.last"), "runs")
    first = runs.groupBy("r").agg(F.min(F.struct("d", "t", "p", "last")).alias("o"),
                                  F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = stored(first, "first-runs")       # so that the join below deals out both sides anew and can split a hot run
    same = F.col("d").eqNullSafe(F.col("o.d")) & (F.col("t") == F.col("o.t"))
    later = (runs.join(first, "r").filter(~(same & (F.col("p") == F.col("o.p"))))
             # inside one document the first occurrence itself stays
             .withColumn("p", F.when(same, F.greatest("p", F.col("o.last") + 1)).otherwise(F.col("p")))
             .filter("p <= last"))
    return later.groupBy("d", "t").agg(F.collect_set(F.struct("p", "last")).alias("spans"))   # at most one per line


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS,
                spans_as: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with later repeated runs of lines cut
    from the text. Null texts stay null, empty ones empty; a document of which
    nothing is left keeps its row with an empty text. Earlier means: smaller
    doc_id (null first), then text hash, then line. Rows with equal doc_id and
    text are one document and treated alike. ``spans_as``: name of a further
    column with the deleted line spans."""
    spans = repeated_spans(docs, doc_id, text, run_words, gram_words)
    rows = docs.select(whole_row(docs).alias("_row"), F.col(q(doc_id)).cast("long").alias("_d"),
                       F.xxhash64(F.col(q(text))).alias("_t"))
    joined = rows.join(spans, F.col("_d").eqNullSafe(F.col("d")) & (F.col("_t") == F.col("t")), "left")
    before = F.col(f"_row.{q(text)}")
    keep = F.filter(F.split(before, "\n"), lambda x, i: ~F.exists(
        "spans", lambda y: (y["p"] <= i) & (i <= y["last"])))
    cut = F.when(F.col("spans").isNull(), before).otherwise(F.array_join(keep, "\n"))
    out = joined.select(*[cut.alias(c) if c == text else F.col(f"_row.{q(c)}").alias(c) for c in docs.columns],
                        *([F.array_sort("spans").alias(spans_as)] if spans_as else []))
    return out


def op3_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after line dedup and what was cut."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.length(text).cast("long").alias("before"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    return dedup_lines(docs).select("doc_id", "text", "n_lines", (F.col("before") - F.length(text)).alias("cut_chars"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS p
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l
), s AS (
  SELECT doc_id, line, p, w, sum(w) OVER (PARTITION BY doc_id ORDER BY p) - w AS s FROM w WHERE w > 0
), r AS (
  SELECT doc_id, p, list(line) OVER g AS run, sum(w) OVER g AS rw, max(p) OVER g AS last
  FROM s WINDOW g AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), k AS (
  SELECT doc_id, p, last, md5(array_to_string(run, chr(10))) AS run FROM r WHERE rw >= 50
), f AS (
  SELECT run, min({'doc_id': doc_id, 'p': p, 'last': last}) AS o FROM k GROUP BY run
), x AS (
  SELECT k.doc_id, CASE WHEN k.doc_id = o.doc_id THEN greatest(k.p, o.last + 1) ELSE k.p END AS p, k.last
  FROM k JOIN f USING (run) WHERE NOT (k.doc_id = o.doc_id AND k.p = o.p)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, last + 1)) AS p FROM x WHERE p <= last
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.p) AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p WHERE g.p IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
       CAST(length(coalesce(d.text, '')) - length(coalesce(kept.text, '')) AS BIGINT) AS cut_chars
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
