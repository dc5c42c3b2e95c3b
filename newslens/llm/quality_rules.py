"""Quality rules whose thresholds come from quantile sketches per language and source.

Only DataFrame functions. Texts are measured in one pass without a shuffle; sketches are counts
per bucket, summed in the map tasks, so any share of rows in one source costs a task nothing.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newslens.llm.tables import SPACE, keep, let, words

SYMBOLS = "[#*$%&|<>]"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Groups with fewer measured documents use the thresholds of their language, then of all.
MIN_GROUP = 100
# A threshold lies so many interquartile ranges outside the quartiles.
RANGES = 3
# What a rate may always exceed the quartiles by, so that groups of even documents lose none:
# symbols per 1,000 words, repeated lines per 1,000 lines, repeated words per 1,000 words, and
# hundredths of a character per word.
SLACK = {"symbol_rate": 100, "dup_line_rate": 300, "repeat_rate": 200, "word_length": 50}
# Rates that may also be too low.
TWO_SIDED = ["word_length"]
SKETCH_BITS = 7
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(tokens):
    """Words inside windows of eight words that occur twice or more in the text."""
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (REPEAT_WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(tokens, i, REPEAT_WINDOW)),
    )

    def covered(starts):
        """Words that windows at these sorted starts cover."""
        steps = F.transform(
            starts, lambda x, i: F.least(F.get(starts, i + 1) - x, F.lit(REPEAT_WINDOW))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def count(hashes):
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(pairs):
            twice = F.filter(
                pairs,
                lambda p, i: F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False))
                | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(twice, lambda p: p["i"]))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(by_hash, lambda pairs: let(repeated(pairs), covered))
        )

    return F.when(F.size(tokens) < REPEAT_WINDOW, 0).otherwise(let(hashes, count))


def _text_measures(text):
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda tokens: let(
            lines,
            lambda lines: F.struct(
                F.size(tokens).alias("n_words"),
                F.length(F.array_join(tokens, "")).alias("word_chars"),
                (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
                _repeat_words(tokens).alias("n_repeat_words"),
                F.size(lines).alias("n_lines"),
            ),
        ),
    )


def row_hash():
    """Tells rows apart that share a doc_id: the columns that a verdict depends on."""
    parts = [F.col("text")]
    for c in ("lang", "source"):
        parts += [F.isnull(c), F.col(c)]
    return F.xxhash64(*parts)


def measure(docs, doc_id="doc_id", text="text", lang="lang", source="source"):
    """Counts and rates of each row; rates are NULL where the fixed rules already fail."""
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.col(lang).alias("lang"), F.col(source).alias("source"),
    )
    measured = named.select(
        "doc_id", "lang", "source", row_hash().alias("row_hash"),
        _text_measures(F.coalesce("text", F.lit(""))).alias("m"),
    ).select("doc_id", "lang", "source", "row_hash", "m.*")
    for c in [*COUNTS, "n_lines"]:
        measured = measured.withColumn(c, F.col(c).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    rates = {
        "symbol_rate": "1000 * n_symbols div n_words",
        "dup_line_rate": "1000 * n_dup_lines div n_lines",
        "repeat_rate": "1000 * n_repeat_words div n_words",
        "word_length": "100 * word_chars div n_words",
    }
    return measured.withColumn("base_failed", failed).withColumns(
        {name: F.expr(f"CASE WHEN NOT base_failed THEN {rate} END") for name, rate in rates.items()}
    )


def sketch_bucket(value):
    """Smallest value of a bucket: exact below 128, then seven leading bits (under 1 % wide)."""
    surplus = F.length(F.bin(value)) - SKETCH_BITS
    return F.when(value < 1 << SKETCH_BITS, value).otherwise(
        F.call_function("shiftleft", F.call_function("shiftright", value, surplus), surplus)
    )


def sketches(measured):
    """Mergeable quantile sketches: counts per (lang, source, rate, bucket).

    Merging is adding; a sketch holds at most a few thousand buckets for any number of documents.
    """
    rate = F.explode(
        F.array(*(F.struct(F.lit(r).alias("rate"), F.col(r).alias("value")) for r in SLACK))
    )
    rows = measured.where("NOT base_failed").select("lang", "source", rate.alias("r"))
    rows = rows.select("lang", "source", "r.rate", sketch_bucket(F.col("r.value")).alias("bucket"))
    return rows.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def _levels(sketch):
    """Sketches of each source (level 0), merged per language (1) and over all (3)."""
    return sketch.groupingSets(
        [["rate", "bucket", "lang", "source"], ["rate", "bucket", "lang"], ["rate", "bucket"]],
        "rate", "bucket", "lang", "source",
    ).agg(F.sum("n").alias("n"), (F.grouping("lang") * 2 + F.grouping("source")).alias("level"))


def thresholds(sketch, min_group=MIN_GROUP):
    """One row per (lang, source) with the highest and lowest rate that passes."""
    group = ["level", "lang", "source", "rate"]
    ordered = Window.partitionBy(*group).orderBy("bucket")
    all_rows = Window.partitionBy(*group)
    ranked = _levels(sketch).select(
        *group, "bucket",
        F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(all_rows).alias("total"),
    )
    quartiles = ranked.groupBy(*group).agg(
        F.max("total").alias("total"),
        F.min(F.when(F.expr("4 * upto >= total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.expr("4 * upto >= 3 * total"), F.col("bucket"))).alias("q3"),
    )
    bounds = []
    for name, slack in SLACK.items():
        this = F.col("rate") == name
        spread = RANGES * (F.col("q3") - F.col("q1")) + slack
        bounds.append(F.max(F.when(this, F.col("q3") + spread)).alias(f"max_{name}"))
        if name in TWO_SIDED:
            bounds.append(F.max(F.when(this, F.col("q1") - spread)).alias(f"min_{name}"))
    by_level = quartiles.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *bounds)
    own = by_level.where("level = 0").select("lang", "source", F.col("total").alias("own"))
    language = F.sum("own").over(Window.partitionBy("lang"))
    level = F.when(F.col("own") >= min_group, 0).when(language >= min_group, 1).otherwise(3)
    own = own.select("lang", "source", level.alias("use"))
    own = own.withColumns({
        "use_lang": F.when(F.col("use") < 3, F.col("lang")),
        "use_source": F.when(F.col("use") < 1, F.col("source")),
    })
    found = by_level.drop("total").withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    return own.join(
        found,
        (F.col("use") == F.col("level"))
        & F.col("use_lang").eqNullSafe(F.col("of_lang"))
        & F.col("use_source").eqNullSafe(F.col("of_source")),
    ).drop("use", "use_lang", "use_source", "of_lang", "of_source", "level")


def verdicts(docs, min_group=MIN_GROUP, **columns):
    """One row per document: its counts, base_failed, rates, thresholds and `kept`.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. Others
    are kept if each rate lies within the thresholds of their language and source, at three
    interquartile ranges outside the quartiles of all documents that pass the fixed rules. NULL
    texts have no words and fail; NULL languages and sources are groups of their own. Repeated
    rows and ids are measured and returned row by row. An empty table gives no rows.
    """
    measured = keep(measure(docs, **columns), "quality-measures")
    # A few numbers per source. Written, so that the planner knows the size before it joins.
    limits = keep(thresholds(sketches(measured), min_group), "quality-thresholds")
    limits = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = measured.join(
        limits,
        F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")),
        "left",
    ).drop("of_lang", "of_source")
    passes = ~F.col("base_failed")
    for name in SLACK:
        passes &= F.col(name) <= F.col(f"max_{name}")
        if name in TWO_SIDED:
            passes &= F.col(name) >= F.col(f"min_{name}")
    return joined.withColumn("kept", F.coalesce(passes, F.lit(False)))


def keep_good(docs, min_group=MIN_GROUP):
    """The rows of `docs` (doc_id, text, lang, source, ...) whose verdict is `kept`.

    Other columns, whatever their names, stay as they are.
    """
    good = verdicts(docs, min_group).where("kept").select(
        F.col("doc_id").alias("good_id"), F.col("row_hash").alias("good_hash")
    ).distinct()
    return docs.join(
        good, docs["doc_id"].eqNullSafe(good["good_id"]) & (row_hash() == good["good_hash"]),
        "left_semi",
    )
