"""Quality rules: hashed n-gram log-likelihood ratios between a trusted target and the raw corpus.

Words and pairs of words are hashed into buckets. One multinomial over the buckets is counted over every document,
another over a bounded sample of documents that are labelled good; a document's score is the mean log ratio of the two
over its own n-grams. Everything is built-in expressions: the model is one array of ``buckets`` numbers that a scalar
subquery hands to the scoring scan, so scoring neither joins nor shuffles and rows that repeat keep one result each.

Base rules run beside the score: too few words, or too many words in windows that repeat within the text.

Defined results: a NULL or empty text has no words, fails the base rules and is rejected; without any labelled good
document every score is 0; a document with no n-gram scores 0; labels with a NULL ``doc_id`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.bounds import unroll
from evidentia.llm.common import WHITE, fresh, let, spaced, table, white_words

#: Well above the number of frequent words and pairs, so that those of junk have buckets of their own (2 MB of numbers).
BUCKETS = 1 << 18
#: Bound of the labelled sample the target multinomial is fitted on (see ``target_ids``).
TARGET_DOCS = 4_096
#: Mean log ratio per n-gram below which a document is rejected.
THRESHOLD = -0.1
SMOOTHING = 1.0
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def target_ids(labels: DataFrame, bound: int = TARGET_DOCS) -> DataFrame:
    """At most ``bound`` documents labelled good, those with the smallest hashes of their ID."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _joined(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` places on; shorter by ``step``."""
    left = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), left), F.slice(hashes, F.lit(1 + step), left), lambda a, b: F.xxhash64(a, b))


def _bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with one array: the log ratio of each bucket.

    Both multinomials come from one scan: counts are summed per task before the shuffle, which so moves ``buckets``
    rows a task. ``targets`` holds at most ``TARGET_DOCS`` IDs and is broadcast. Raw counts are brought to the size of the
    target before both are smoothed, so that scores do not drift with the sizes of the corpus, the sample and the array.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(targets.select("doc_id", F.lit(1).alias("__good"))), "doc_id", "left")
    hashed = marked.select("__good", F.transform(white_words(F.col("text")), lambda w: F.xxhash64(w)).alias("__w"))
    beside = F.explode(F.arrays_zip(F.col("__w"), F.slice("__w", 2, F.size("__w")).alias("__next")))
    pairs = hashed.where(F.size("__w") > 0).select("__good", beside.alias("__z")).select("__good", "__z.__w", "__z.__next")
    both = F.array(_bucket(F.col("__w"), buckets), F.when(F.col("__next").isNotNull(), _bucket(F.xxhash64("__w", "__next"), buckets)))
    grams = pairs.select("__good", F.explode(both).alias("__b")).where(F.col("__b").isNotNull())
    counts = grams.groupBy("__b").agg(F.count("*").alias("__raw"), F.count("__good").alias("__target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("__b"))
    full = every.join(counts, "__b", "left").na.fill(0, ["__raw", "__target"])
    packed = full.agg(
        F.sum("__raw").alias("raw"), F.sum("__target").alias("target"),
        F.array_sort(F.collect_list(F.struct("__b", "__raw", "__target"))).alias("cells"))
    share = F.col("target") / F.col("raw")
    ratio = lambda c: F.log((c["__target"] + smoothing) / (c["__raw"] * share + smoothing))
    return packed.select(F.when(F.col("target") == 0, F.array_repeat(F.lit(0.0), buckets)).otherwise(
        F.transform("cells", ratio)).alias("ratios"))


def _repeat_words(pairs: Column) -> Column:
    """Words that lie in a window found twice or more.

    A text in which no window of four words repeats, as in most, is done after two hashes a word. In the others,
    sorting the windows of eight by hash puts equal ones side by side.
    """
    unlike = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    none = F.lit(0).cast("long")

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            beside = lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])
            return F.sort_array(F.transform(F.filter(s, beside), lambda x: x["i"]))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            let(ordered, positions), start,
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    eight = lambda fours: let(_joined(fours, 4), lambda w: F.when(unlike(w), none).otherwise(covered(w)))
    return let(_joined(pairs, 2), lambda fours: F.when(unlike(fours), none).otherwise(eight(fours)))


def judge_documents(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, bound: int = TARGET_DOCS,
) -> tuple[DataFrame, str]:
    """Every row of ``docs`` with a struct column of its counts, score and verdict; also the name of that column."""
    result, parts, hashes, pairs, ratios = fresh(docs, "quality", "__parts", "__hashes", "__pairs", "__ratios")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    part_count = F.size(parts)
    prepared = (
        docs.withColumn(ratios, log_ratios(docs, target_ids(labels, bound), buckets).scalar())
        .withColumn(parts, F.split(spaced(F.col("text")), " "))
        .withColumn(hashes, F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w)))
        .withColumn(pairs, _joined(F.col(hashes), 1)))
    total = let(F.col(ratios), lambda m: F.aggregate(
        F.concat(hashes, pairs), F.lit(0.0), lambda acc, h: acc + F.get(m, _bucket(h, buckets))))
    n_grams = F.size(hashes) + F.size(pairs)
    counted = F.struct(
        F.size(hashes).cast("long").alias("n_words"),
        (F.length(text) - (part_count - 1)).cast("long").alias("word_chars"),
        (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(pairs)).alias("n_repeat_words"),
        F.when(n_grams == 0, F.lit(0.0)).otherwise(total / n_grams).alias("score"))
    scored = prepared.withColumn(result, counted).drop(parts, hashes, pairs, ratios)
    r = F.col(result)
    failed = (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > MAX_REPEAT_PERCENT * r["n_words"])
    kept = ~failed & (r["score"] >= threshold)
    return scored.withColumn(result, r.withField("base_failed", failed).withField("kept", kept)), result


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept.

    A plain filter on the verdict would be pushed below the columns it is made of, which repeats their expressions; a
    filter on the place of an unrolled array is not.
    """
    judged, result = judge_documents(docs, labels)
    [mark] = fresh(judged, "__kept")
    return unroll(judged, docs.columns, F.when(F.col(result)["kept"], F.array(F.lit(1))), mark).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, result = judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[f"{result}.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")])
