"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of each document are compared with references of each language by the Jensen-Shannon distance (base 2,
0 to 1): the classes of its characters, and how often each of the languages' common words occurs (all other words are
one bucket). A document is kept if, in both histograms, some language's reference is near enough. Texts below the
minimum lengths give no stable histogram and are not judged by it. The references are the mean histograms of all
documents of a language that pass the base rules, learned in two rounds, the second without what the first rejects.

Small letters are most of a text and are cut out once; all other characters are counted in what is left. Words are put in
order to find repeated windows only where hashes say that some repeat.

Per-row work is array functions; only the narrow features are stored, and the only shuffle is the mean per language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, stored, words

# Common words by language.
COMMON_WORDS = {
    "en": "the of and to in is that for was with on as are by it at be from this".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au".split(),
    "es": "de la que el en y a los del se las por un para con una su al lo".split(),
}
ALL_COMMON = list(dict.fromkeys(w for own in COMMON_WORDS.values() for w in own))
# Character classes besides white space and the rest.
# Each pattern takes away all characters but those of the class.
CLASSES = {"lower": "[^a-z]+", "upper": "[^A-Z]+", "letter": r"[^\p{L}]+|[a-zA-Z]+", "digit": "[^0-9]+", "mark": "[^.,;:!?'\"()\\-]+"}

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Least words and characters of a text that is judged by its histograms.
MIN_HISTOGRAM_WORDS, MIN_HISTOGRAM_CHARS = 50, 200
#: Greatest distance to the nearest reference that is still kept.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.45


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def with_rest(rows: DataFrame) -> DataFrame:
    """Add ``rest``, the text without a to z."""
    return rows.withColumn("rest", F.regexp_replace(_text(), "[a-z]+", ""))


def base_features(rows: DataFrame) -> DataFrame:
    """Add the counts of the base rules to (``text``, ``rest``, ``words``)."""
    text, w, rest = _text(), F.col("words"), F.col("rest")
    hashes = F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    # Equal windows have equal hashes: without a repeated hash there is none to find.
    triples = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("p"))),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    order = F.col("_triples")

    def twice(x: Column, i: Column) -> Column:
        return F.coalesce(x["t"] == F.get(order, i - 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get(order, i + 1)["t"], F.lit(False))

    places = F.col("_places")
    covered = F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return (
        rows.withColumn("_hashes", hashes)
        .withColumn("_triples", F.sort_array(triples))
        .withColumn("_places", F.sort_array(F.transform(F.filter(order, twice), lambda x: x["p"])))
        .withColumns({
            "n_words": F.size(w).cast("long"),
            "word_chars": (F.length(text) - F.length(rest) + _without(rest, SPACE + "+")).cast("long"),
            "n_symbols": _without(rest, "[^#*$%&|<>]+"),
            "n_dup_lines": bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        })
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
        .drop("_hashes", "_triples", "_places")
    )


def histograms(rows: DataFrame) -> DataFrame:
    """Add to (``text``, ``rest`` and the base counts) n_chars_all, classes (counts by character class) and common (counts by common word, the others last)."""
    text = _text()
    # The common words of the text with a space on both sides of each; the shortening without a word counts it.
    own = F.filter(F.split(text, r"[\x20\x09-\x0D.,;:!?]+"), lambda x: x.isin(ALL_COMMON))
    kept = F.concat(F.lit(" "), F.array_join(own, "  "), F.lit(" "))

    def count(joined: Column, word: str) -> Column:
        return ((F.length(joined) - F.length(F.replace(joined, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("long")

    common = bind(kept, lambda s: F.array(*(count(s, w) for w in ALL_COMMON)))
    filled = lambda total, parts: F.concat(parts, F.array(total - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)))
    counts = {"lower": (F.length(text) - F.length("rest")).cast("long")} | {c: _without(F.col("rest"), others) for c, others in CLASSES.items() if c != "lower"}
    classes = F.array(*(counts[c] for c in CLASSES), (F.length(text) - F.col("word_chars")).cast("long"))
    return rows.withColumns({
        "n_chars_all": F.length(text).cast("long"),
        "classes": bind(classes, lambda x: filled(F.length(text).cast("long"), x)),
        "common": bind(common, lambda x: filled(F.col("n_words"), x)),
    })


def features(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` with all counts of every row, stored, so that texts are read once."""
    rows = with_rest(docs.select(*carry, F.col("text"), F.col("lang"), words(F.col("text")).alias("words")))
    return stored(histograms(base_features(rows)).drop("text", "rest", "words"), "quality")


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return bind(total, lambda n: F.transform(counts, lambda x: x / F.when(n > 0, n)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2))


def judged() -> Column:
    return (F.col("n_words") >= MIN_HISTOGRAM_WORDS) & (F.col("n_chars_all") >= MIN_HISTOGRAM_CHARS)


def with_distances(rows: DataFrame, references: list[tuple[list[float], list[float]]]) -> DataFrame:
    """Add the distance to the nearest reference of each kind; 0 where the text is too short or nothing is known."""

    def nearest(counts: str, kind: int) -> Column:
        if not references:
            return F.lit(0.0)
        near = bind(_shares(F.col(counts)), lambda p: F.array_min(F.array(*(distance(p, F.array(*map(F.lit, r[kind]))) for r in references))))
        return F.when(judged(), near).otherwise(F.lit(0.0))

    return rows.withColumn("class_distance", nearest("classes", 0)).withColumn("word_distance", nearest("common", 1))


def accepted() -> Column:
    return (F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("word_distance") <= MAX_WORD_DISTANCE)


def references(rows: DataFrame) -> list[tuple[list[float], list[float]]]:
    """(class shares, word shares) of each listed language that has judged documents: at most one pair a language."""

    def learn(some: DataFrame) -> list[tuple[list[float], list[float]]]:
        good = some.where(~F.col("base_failed") & judged() & F.col("lang").isin(list(COMMON_WORDS)))
        shares = good.select("lang", _shares(F.col("classes")).alias("p"), _shares(F.col("common")).alias("q"))
        sizes = {"p": len(CLASSES) + 2, "q": len(ALL_COMMON) + 1}
        means = shares.groupBy("lang").agg(*(F.round(F.avg(F.col(c)[i]), 9).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)))
        return [tuple([r[f"{c}{i}"] for i in range(n)] for c, n in sizes.items()) for r in means.sort("lang").collect()]

    return learn(with_distances(rows, learn(rows)).where(accepted()))


def judged_rows(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry``, the counts, both distances, base_failed and kept for every row of ``docs``."""
    rows = features(docs, carry)
    return with_distances(rows, references(rows)).withColumn("kept", ~F.col("base_failed") & accepted())


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, one row a row of ``docs``.

    Null and empty texts have no words and fail the base rules. A null or unlisted language gives no reference; such
    documents are still judged by the nearest one. Repeated rows and doc_ids stay rows of their own. Very long texts
    are sorted within their row. Other columns are ignored whatever their names; an empty table gives an empty table.
    """
    rows = judged_rows(docs, [F.col("doc_id")])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that the rules reject."""
    return judged_rows(docs, [F.struct("*").alias("row")]).where("kept").select("row.*")
