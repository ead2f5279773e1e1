"""Quality rules: base counts and a hashed n-gram log-likelihood ratio (operator 5), in DataFrame functions only.

Words are maximal runs without the six ASCII white-space characters. Hashed words and word pairs of
two corpora make two multinomials over ``buckets`` buckets: the trusted target (documents labelled
good) and the raw corpus (all documents). A document's score is the mean, over its
n-grams, of the log of the ratio of the two smoothed probabilities. A document is kept if it passes
the base rules and its score is at least ``threshold``; nothing is drawn at random.

The raw counts cover all documents, the target all documents labelled good. Their ids become one mask for
each block of 64 ids, 1 bit an id where ids are dense. Up to ``SENT`` masks are sent to all workers and texts
are not shuffled; more are joined by salted keys, so that rows without an id or with the same one are dealt
out too, and texts are shuffled once. The model is one array of ``buckets`` numbers, whatever the size of the corpus.

Defined results: null text is no words and fails the base rules; null ids and repeated rows are
judged like any others; without labels or documents the ratio is 0 throughout; an empty table gives
no rows; other columns, whatever their names, come through judged() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white-space characters that part words, and the symbols that are counted.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
BUCKETS, SMOOTHING, THRESHOLD = 1 << 18, 4.0, -0.20
#: Buckets that are counted in one group.
SLOTS = 4
#: Masks of 64 ids that are sent to all workers, and the parts that a key is dealt out to where there are more.
SENT, SALTS = 500_000, 16


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row: the optimizer merges projections, but not across a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def joined(left: Column, right: Column, skip: int) -> Column:
    """A hash of each element of ``left`` with the one of ``right`` that lies ``skip`` places on."""
    n = F.size(right) - skip
    return F.when(n > 0, F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, skip + 1, n), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def counted(rows: DataFrame, buckets: int) -> DataFrame:
    """good, bucket: one row for each word of ``words`` and for each pair of neighbours. Rows are made before they are
    hashed, so that the hashes are compiled; a lambda over an array is not."""
    pairs = F.arrays_zip(F.col("words").alias("word"), F.slice("words", F.lit(2), F.size("words")).alias("next"))
    rows = rows.select("good", F.explode(pairs).alias("at"))
    one = F.xxhash64("at.word")
    both = F.array(one, F.when(F.col("at.next").isNotNull(), F.xxhash64(one, F.xxhash64("at.next"))))
    rows = rows.select("good", F.explode(both).alias("hash")).where("hash is not null")
    return rows.select("good", F.pmod("hash", F.lit(buckets)).cast("int").alias("bucket"))


def covered_words(windows: Column) -> Column:
    """Words in windows of ``WINDOW`` words whose hash stands among ``windows`` twice or more."""
    listed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(all_: Column) -> Column:
        return F.filter(all_, lambda x, k: F.get(all_, k + 1)["h"].eqNullSafe(x["h"]) | ((k > 0) & F.get(all_, k - 1)["h"].eqNullSafe(x["h"])))

    def spread(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda n, x: n + x)

    # A list of one element carries each step's result into the next, so that it is computed once.
    steps = F.transform(F.transform(F.array(listed), twice), lambda t: F.sort_array(F.transform(t, lambda x: x["i"])))
    return F.element_at(F.transform(steps, spread), 1)


def marked(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``texts`` with ``good``: 1 for the ids of ``labels``, null for others."""
    from linkmill.llm.runtime import staged

    def block(id_: Column) -> Column:
        return F.shiftright(id_, 6)

    def place(id_: Column) -> Column:
        return id_.bitwiseAND(F.lit(63)).cast("int")

    ids = labels.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    masks = staged(ids.groupBy(block(F.col("id")).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("mask")), "masks")
    on = block(F.col("doc_id")) == F.col("block")
    if masks.count() <= SENT:
        found = texts.join(F.broadcast(masks), on, "left")
    else:
        masks = masks.withColumn("mask_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = texts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        found = salted.join(masks, on & (F.col("salt") == F.col("mask_salt")), "left")
    return found.select(*texts.columns, F.when(F.getbit("mask", place(F.col("doc_id"))) == 1, 1).alias("good"))


def ratio_model(texts: DataFrame, labels: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """One row, ``model``: the log ratio of each bucket."""
    rows = marked(texts, labels.where("quality = 1")).select("good", words_of(F.col("text")).alias("words"))
    rows = held(rows.where(F.size("words") > 0), "held", F.col("words")).select("good", F.col("held").alias("words"))
    # Neighbouring buckets are counted in one group, so that a task's groups stay few enough to be found quickly.
    slots = range(SLOTS)
    rows = counted(rows, buckets).select("good", F.floor(F.col("bucket") / SLOTS).cast("int").alias("group"), (F.col("bucket") % SLOTS).alias("slot"))
    sums = [f(F.when(F.col("slot") == k, value)).alias(f"{name}{k}") for k in slots for name, f, value in (("raw", F.count, F.lit(1)), ("target", F.count, F.col("good")))]
    groups = rows.groupBy("group").agg(*sums)
    each = F.array(*(F.struct((F.col("group") * SLOTS + k).alias("bucket"), F.col(f"raw{k}").alias("raw"), F.col(f"target{k}").alias("target")) for k in slots))
    counts = groups.select(F.inline(each))
    spark = texts.sparkSession
    counts = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))

    def ratio(x: Column) -> Column:
        # Both multinomials are smoothed by the same share of their totals: where the raw corpus promises
        # the target few n-grams of a bucket, finding none says little.
        promised = x["raw"] * F.col("target") / F.col("raw")
        return F.when((F.col("target") > 0) & (F.col("raw") > 0), F.log((x["target"] + smoothing) / (promised + smoothing))).otherwise(F.lit(0.0))

    return listed.select(F.transform("c", ratio).alias("model"))


#: The columns that judged() adds.
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """row (a struct of the columns of ``docs``) and the columns RULES."""
    from linkmill.llm.runtime import staged

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The corpus is counted once, before any document is judged.
    model = staged(ratio_model(rows.select("doc_id", "text"), labels, buckets, smoothing), "ratios")
    rows = held(rows, "words", words_of(F.col("text")))
    text, words = F.coalesce("text", F.lit("")), F.col("words")
    rows = held(rows, "lines", F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != ""))
    rows = rows.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("lines", "text")
    rows = held(rows, "one", word_hashes(words)).drop("words")
    rows = held(rows, "two", joined(F.col("one"), F.col("one"), 1))
    rows = held(rows, "four", joined(F.col("two"), F.col("two"), 2))
    # A text that repeats no four words repeats no window; only the others are looked at closely.
    repeats = F.size(F.array_distinct("four")) < F.size("four")
    rows = held(rows, "windows", F.when(repeats, joined(F.col("four"), F.col("one"), WINDOW - 1)))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("n_repeat_words", F.when(repeats, covered_words(F.col("windows"))).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    rows = rows.withColumn("grams", F.size("one") + F.size("two"))
    # One reference, so that the optimizer puts the array where it is used instead of into every row.
    rows = rows.withColumn("ratios", model.scalar())
    total = F.aggregate(F.concat("one", "two"), F.lit(0.0), lambda s, h: s + F.get("ratios", F.pmod(h, F.lit(buckets)).cast("int")))
    rows = rows.select("row", "grams", *(c for c in RULES if c not in ("score", "kept")), total.alias("total"))
    rows = rows.withColumn("score", F.when(F.col("grams") > 0, F.round(F.col("total") / F.col("grams"), 9)).otherwise(F.lit(0.0)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select("row", *RULES)


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns of op5."""
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
