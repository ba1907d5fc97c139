"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact weighted-shingle similarity.

A window of a document is as long as a benchmark item, in words, and may begin at any word. A window and an item of a and
b shingles can only reach the similarity if they share ``percent * (a + b) / (100 + percent)`` of them, so windows with
fewer places of shingles of items of that length are not built; in whatever order the shingles stand, none is lost. Each
window and each item has a 64-bit SimHash of its shingles, counted as often as they occur. The index has each item's
eight 8-bit blocks with all keys within ``radius // 8`` bits; two fingerprints within ``radius`` bits agree with the
other's key in at least one block, so the search finds all of them. Every candidate is then compared exactly: shared
shingles by the lesser count over all by the greater count. Equal texts are searched once; the search carries names and
fingerprints only, and a candidate's shingles meet in one row.

All steps are DataFrame functions. The shingles of the items are broadcast in blocks of at most ``BROADCAST_SHINGLES``
(one block for up to some thousands of items); a larger benchmark takes one pass over the documents a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, stored

SHINGLE, SIMILARITY_PERCENT, RADIUS, BLOCKS = 5, 80, 23, 8
#: Shingles broadcast at once, about 40 bytes each.
BROADCAST_SHINGLES = 500_000
#: Leaking texts up to which their keys are broadcast, about 40 bytes each; more are joined by a shuffle.
BROADCAST_LEAKS = 200_000


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def shingle_keys(words: Column, size: int = SHINGLE) -> Column:
    """A hash for each run of ``size`` words, in order."""
    return F.transform(_positions(F.size(words) - size + 1), lambda i: F.xxhash64(*(F.get(words, i + d) for d in range(size))))


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """The runs of ``size`` words as strings; of fewer words the whole sequence."""
    return F.transform(_positions(F.greatest(F.size(words) - size + 1, F.least(F.size(words), F.lit(1)))), lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def simhash(parts: Column) -> Column:
    """The 64-bit SimHash of an array of strings: a bit is set if more than half of the hashes have it."""

    def of(hashes: Column) -> Column:
        def bit(b: Column) -> Column:
            ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int"))
            return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return bind(F.transform(parts, lambda s: F.xxhash64(s)), of)


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * b).bitwiseAND(F.lit(255)).cast("int")


def _near_keys(bits: int) -> list[int]:
    """The 8-bit differences of at most ``bits`` ones."""
    return [x for x in range(256) if x.bit_count() <= bits]


def item_table(bench: DataFrame) -> DataFrame:
    """item_id, words, n_words, item_key (of the words), parts (shingles) and fp of every item that has a word; repeated items count once."""
    words = bench.select("item_id", plain_words(F.col("text")).alias("words")).distinct().where(F.size("words") > 0)
    return stored(
        words.select("item_id", "words", F.size("words").alias("n_words"), F.md5(F.concat_ws(" ", "words")).alias("item_key"), shingles(F.col("words")).alias("parts"))
        .withColumn("fp", simhash(F.col("parts"))), "items",
    )


def _starts(places: Column, n: Column, n_words: Column, percent: int) -> Column:
    """The starts of all windows with as many of the sorted ``places`` (of shingles) as the similarity takes."""
    size = F.least(n_words, F.lit(SHINGLE))
    wide, whole = F.least(n, n_words) - size + 1, n_words - size + 1
    need = F.ceil(percent * (wide + whole) / (100 + percent) - 1e-9).cast("int")

    def between(i: Column) -> Column:
        """Windows that hold the i-th place and the ``need - 1`` next."""
        first = F.greatest(F.lit(0), F.get(places, i + need - 1) - wide + 1)
        last = F.least(F.get(places, i), F.greatest(F.lit(0), n - n_words))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(_positions(F.size(places) - need + 1), between)))


def windows(docs: DataFrame, items: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(text_key, n_words, start, fp, parts): the item-sized windows with enough shingles of items, each once a text."""
    sizes = [r[0] for r in items.select(F.least("n_words", F.lit(SHINGLE))).distinct().collect()]
    rows = docs.select(text_key().alias("text_key"), "text")
    texts = rows.select("text_key", plain_words(F.col("text")).alias("words"))
    found = None
    for size in sorted(sizes):
        own = items.where((F.col("n_words") == size) if size < SHINGLE else (F.col("n_words") >= size))
        anchors = own.select("n_words", F.explode(shingle_keys(F.col("words"), size)).alias("key")).distinct()
        anchors = stored(anchors.groupBy("key").agg(F.collect_set("n_words").alias("lengths")), "anchors")
        blocks = -(-anchors.count() // BROADCAST_SHINGLES)
        for block in range(blocks):
            part = anchors.where(F.expr(f"pmod(xxhash64(key), {blocks})") == block) if blocks > 1 else anchors
            hits = (
                texts.select("text_key", F.size("words").alias("n"), F.posexplode(shingle_keys(F.col("words"), size)).alias("pos", "key"))
                .join(F.broadcast(part), "key")
                .select("text_key", "n", "pos", F.explode("lengths").alias("n_words"))
            )
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = texts.select("text_key", F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(0).alias("n_words")).limit(0)
    # Equal texts have the same windows, so these are found once a text.
    places = found.groupBy("text_key", "n", "n_words").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    starts = places.select("text_key", "n_words", _starts(F.col("places"), F.col("n"), F.col("n_words"), percent).alias("starts")).where(F.size("starts") > 0)
    starts = stored(starts.groupBy("text_key").agg(F.collect_list(F.struct("n_words", "starts")).alias("lengths")), "starts")
    size = starts.agg(F.count(F.lit(1)), F.sum(F.aggregate("lengths", F.lit(0), lambda k, x: k + F.size(x["starts"])))).first()
    starts = F.broadcast(starts) if max(size[0], (size[1] or 0) // 8) <= BROADCAST_LEAKS else starts
    # A window is cut out of the words where they are; the words themselves are not repeated for each window.
    window = lambda w, k, at: F.struct(k.alias("n_words"), at.alias("start"), F.slice(w, at + 1, k).alias("words"))
    cut = F.transform("lengths", lambda x: F.transform(x["starts"], lambda at: window(F.col("words"), x["n_words"], at)))
    windows = (
        rows.join(starts, "text_key").select("text_key", "lengths", plain_words(F.col("text")).alias("words"))
        .select("text_key", F.explode(F.flatten(cut)).alias("window")).select("text_key", "window.*").dropDuplicates(["text_key", "n_words", "start"])
    )
    parts = windows.select("text_key", "n_words", "start", shingles(F.col("words")).alias("parts"))
    return stored(parts.withColumn("fp", simhash(F.col("parts"))), "windows")


def candidates(found: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(text_key, n_words, start, item_key): windows with every item of their length whose fingerprint is within the radius."""
    near = F.array(*(F.lit(x) for x in _near_keys(radius // BLOCKS)))

    def keys(b: int) -> Column:
        return F.transform(near, lambda x: _block(F.col("fp"), b).bitwiseXOR(x) + F.lit(b << 8))

    # Fingerprints and names only: an item stands in the index under some 300 keys, a window asks under eight.
    index = items.dropDuplicates(["item_key"]).select("item_key", "n_words", F.col("fp").alias("item_fp"), F.explode(F.concat(*(keys(b) for b in range(BLOCKS)))).alias("block"))
    asked = found.select("text_key", "n_words", "start", "fp", F.explode(F.array(*(_block(F.col("fp"), b) + F.lit(b << 8) for b in range(BLOCKS)))).alias("block"))
    return (
        asked.join(index, ["n_words", "block"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("text_key", "n_words", "start", "item_key").distinct()
    )


def numbered(parts: Column) -> Column:
    """Each part with how many equal ones stand before it, so that sets of them compare as bags of parts."""

    def of(p: Column) -> Column:
        before = F.transform(_positions(F.size(p)), lambda i: i - F.array_position(p, F.get(p, i)).cast("int") + 1)
        return F.when(F.size(F.array_distinct(p)) == F.size(p), F.transform(p, lambda x: F.concat(x, F.lit("\n0")))).otherwise(
            F.zip_with(p, before, lambda x, i: F.concat_ws("\n", x, i.cast("string"))))

    return bind(F.array_sort(parts), of)


def verified(pairs: DataFrame, found: DataFrame, items: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """text_key, item_id, similarity, first_word: the best window of each text and item.

    The pairs (``candidates``) meet the parts of their windows and items, and are compared row by row.
    """
    key = ["text_key", "n_words", "start"]
    own = items.dropDuplicates(["item_key"]).select("item_key", numbered(F.col("parts")).alias("item_parts"))
    both = pairs.join(found.select(*key, numbered(F.col("parts")).alias("parts")), key).join(own, "item_key")
    shared = F.size(F.array_intersect("parts", "item_parts"))
    counts = both.select("text_key", "item_key", "start", F.size("parts").alias("n"), F.size("item_parts").alias("m"), shared.alias("shared"))
    counts = counts.withColumn("all", F.col("n") + F.col("m") - F.col("shared"))
    similar = counts.where(100 * F.col("shared") >= percent * F.col("all")).withColumn("similarity", F.col("shared") / F.col("all")).join(items.select("item_key", "item_id"), "item_key")
    return similar.groupBy("text_key", "item_id").agg(F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).cast("long").alias("first_word"))


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, similarity, first_word of every document text that repeats a benchmark item.

    ``text_key`` is the MD5 of the text and tells rows of one doc_id (or of none) apart; repeated rows give one result.
    Null and empty texts and items have no words and match nothing; items of fewer than five words are one shingle.
    Other columns are ignored whatever their names; empty tables give an empty result.
    """
    items = item_table(bench)
    found = windows(docs, items)
    bad = stored(verified(candidates(found, items), found, items), "leaking-texts")
    rows = docs.select("doc_id", text_key().alias("text_key")).distinct()
    return rows.join(bad, "text_key").select("doc_id", "text_key", "item_id", "similarity", "first_word")


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose text repeats a benchmark item. Rows with null texts stay."""
    bad = stored(leaks(docs, bench).select("doc_id", "text_key").distinct(), "leaks")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_LEAKS else bad
    rows = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    kept = rows.join(bad, (rows["text_key"] == bad["text_key"]) & F.col("row.doc_id").eqNullSafe(bad["doc_id"]), "left_anti")
    return kept.select("row.*")
