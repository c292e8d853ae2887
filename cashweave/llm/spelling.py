"""Spelling variants: words one edit apart, found by a frontier that moves through a trie of all words.

The trie is a table of edges (direction, depth, node, letter); a node is the prefix it stands for, so it is exact. A state
(word, position, node, edits) says that the word up to its position leads to the node with so many edits. Level by
level the states of one depth are joined with the edges that leave nodes of this depth; a state without an edit follows the
word's own letter, and the others where their letter differs from the word's, as a replaced or an inserted one;
a state with an edit follows the word's letter alone. One that ends on a word of the trie with one edit is a pair
of neighbours. Edges that lead to a single word hold it, so that a state there is settled at once.

An edit falls into the later half of a word or, read backwards, into the later half of the reversed word. So there
are two tries and states start in the middle, where nodes have few children and no node holds many words. Each pair is
reached once: the edit stands at the first letter that differs, a replaced letter is the greater one, a
deletion is the insertion seen from the other word, and backward pairs with equal first halves are left to the other trie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashweave.llm.common import pick, scratch, stored

LETTERS = r"A-Za-zÀ-ÿ"
#: Least code points and occurrences of a word, and how much more frequent its form must be.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A letter is deleted from runs whose hash this divides.
NOISE = 199
#: Longest words in the trie, so also its rounds at most; pairs with a longer word meet in hashes of their deletions.
DEPTH = 40


def _slice(word, at, length=None) -> Column:
    """Code points of ``word`` from ``at`` (from 0) on."""
    length = F.length(word) if length is None else length
    return F.substring(word, at + 1, length)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): all words of at least LEAST_LENGTH letters and LEAST_COUNT occurrences.

    A run of letters, A-Z lowered, whose crc32 behind its document's key and a colon is a multiple of NOISE lacks
    the letter that the hash points at (a NULL key counts as no characters). Shorter runs cannot become words.
    """
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = pick(docs, key, text).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(
        F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % NOISE == 0, F.concat(_slice("run", F.lit(0), at), _slice("run", at + 1))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        (F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _both_ways(words: DataFrame) -> DataFrame:
    """(way, word): each word forwards (0) and backwards (1)."""
    return words.select(F.posexplode(F.array("word", F.reverse("word"))).alias("way", "word"))


def _letter_bit(letter: Column) -> Column:
    """Place of a letter of LETTERS in lower case: 0 .. 89."""
    code = F.ascii(letter)
    return F.when(code < 128, code - ord("a")).otherwise(code - 0xC0 + 26)


def _bits(letter: Column) -> tuple[Column, Column]:
    """The letter as one bit of two long integers; no bit for no letter."""
    at, none = _letter_bit(letter), F.lit(0).cast("long")
    return (F.when((letter != "") & (at < 60), F.expr("1L") * F.pow(F.lit(2.0), at).cast("long")).otherwise(none),
            F.when((letter != "") & (at >= 60), F.pow(F.lit(2.0), at - 60).cast("long")).otherwise(none))


def trie(words: DataFrame) -> DataFrame:
    """Edges (way, depth, node, letter, only, low, high, ends) of the later half of every word, by depth.

    ``only`` is the word below the edge if it is the only one, ``low`` and ``high`` hold the letters that follow the
    edge as bits, ``ends`` tells whether a word ends with it. A state of a word of length m starts at depth m div 2
    at least, and looks for words of up to m + 1 letters, so no edge above (length - 1) div 2 is needed.
    """
    steps = _both_ways(words).withColumn("depth", F.explode(F.sequence(
        F.floor((F.length("word") - 1) / 2).cast("int"), F.length("word") - 1)))
    low, high = _bits(_slice("word", F.col("depth") + 1, F.lit(1)))
    return steps.groupBy("way", "depth", _slice("word", F.lit(0), F.col("depth")).alias("node"),
                         _slice("word", F.col("depth"), F.lit(1)).alias("letter")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("word").alias("_w"), F.bit_or(low).alias("low"), F.bit_or(high).alias("high"),
        F.max(F.length("word") == F.col("depth") + 1).alias("ends")).select(
        "way", "depth", "node", "letter", F.when(F.col("_n") == 1, F.col("_w")).alias("only"), "low", "high", "ends")


def _advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one level down, and those settled on a word: (way, word, position, node, edits, found).

    One outcome of a state at an edge for each way to read the edge's letter; outcomes that the rest of the word
    cannot follow (by the letters behind the edge, or by the only word below it) are dropped here.
    """
    own = _slice("word", F.col("position"), F.lit(1))
    joined = states.join(edges.withColumnRenamed("node", "_node"), (F.col("way") == F.col("_way")) & (F.col("node") == F.col("_node"))
                         & F.when(F.col("edits") == 1, F.col("letter") == own).otherwise(
                             (F.col("letter") != own) | F.col("only").isNull()))
    child, same = F.concat("node", "letter"), F.col("letter") == own

    def outcome(when, step, edits):
        return F.when(when, F.struct((F.col("position") + step).alias("position"), F.lit(edits).alias("edits")))

    fresh = F.col("edits") == 0
    read = joined.select("way", "word", "only", "low", "high", "ends", child.alias("node"), F.explode(F.array(
        outcome(fresh & same, 1, 0),                                    # the word's own path
        outcome((fresh & ~same & (F.col("letter") > own) & (own != "")) | (~fresh & same), 1, 1),  # a replaced letter, or on
        outcome(fresh & ~same, 0, 1))).alias("o")).filter("o IS NOT NULL").select("*", "o.position", "o.edits")
    rest = _slice("word", F.col("position"))
    low, high = _bits(F.substring(rest, 1, 1))
    goes = F.when(rest == "", F.lit(False)).otherwise((F.col("low").bitwiseAND(low) != 0) | (F.col("high").bitwiseAND(high) != 0))
    settled = F.when(F.col("only").isNotNull(), F.col("only") == F.concat("node", rest)).otherwise((rest == "") & F.col("ends"))
    found = F.when((F.col("edits") == 1) & settled, F.concat("node", rest))
    return read.withColumn("found", found).filter(
        found.isNotNull() | (F.col("only").isNull() & ((F.col("edits") == 0) | goes))).select(
        "way", "word", "position", "node", "edits", "found")


def _through_trie(words: DataFrame) -> DataFrame:
    """(a, b): each pair of neighbours among words of at most DEPTH letters, once."""
    spark = words.sparkSession
    folder, frontiers = scratch(spark, "spelling-trie"), []
    trie(words).write.partitionBy("depth").parquet(folder)
    edges = spark.read.schema(
        "way int, node string, letter string, only string, low long, high long, ends boolean, depth int").parquet(folder)
    # A forward state starts behind the first half of its word, a backward one behind the longer half.
    starts = stored(_both_ways(words).select("way", "word", F.when(F.col("way") == 0, F.floor(F.length("word") / 2)).otherwise(
        F.ceil(F.length("word") / 2)).cast("int").alias("position")).select(
        "*", _slice("word", F.lit(0), F.col("position")).alias("node"), F.lit(0).alias("edits")), "spelling-starts")
    first, last, longest = starts.agg(F.min("position"), F.max("position"), F.max(F.length("word"))).first()
    columns = "way int, word string, position int, node string, edits int, found string"
    now, none = None, spark.createDataFrame([], "a string, b string")
    if first is None:
        return none
    for depth in range(first, longest + 1):
        states = starts.filter(F.col("position") == depth)
        if now is not None:
            states = states.unionByName(now.filter("found IS NULL").drop("found"))
        level = edges.filter(F.col("depth") == depth).select(F.col("way").alias("_way"), "node", "letter", "only", "low", "high", "ends")
        path = scratch(spark, f"spelling-level-{depth}")
        _advance(states, level).write.parquet(path)
        now = spark.read.schema(columns).parquet(path)
        frontiers.append(path)
        if depth >= last and now.filter("found IS NULL").isEmpty():
            break
    met = spark.read.schema(columns).parquet(*frontiers).filter("found IS NOT NULL")
    back = F.col("way") == 1
    pairs = met.select(F.when(back, F.reverse("word")).otherwise(F.col("word")).alias("a"),
                       F.when(back, F.reverse("found")).otherwise(F.col("found")).alias("b"), "way")
    half = F.floor(F.length("a") / 2).cast("int")
    return pairs.filter((F.col("way") == 0) | (_slice("a", F.lit(0), half) != _slice("b", F.lit(0), half))).select("a", "b")


def _through_deletions(words: DataFrame) -> DataFrame:
    """(a, b): each pair of neighbours of which one has more than DEPTH letters, once.

    Hashes of a word without its i-th letter: replaced letters agree in length, place and hash (at most one word for
    each letter there), a shortened word is the other without one. An exact test follows.
    """
    long = stored(words.filter(F.length("word") >= DEPTH), "spelling-long")
    gaps = long.select("word", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.xxhash64(
        _slice("word", F.lit(0), i), F.lit("|"), _slice("word", i + 1)))).alias("at", "h"), F.length("word").alias("m"))
    other = gaps.toDF("b", "at", "h", "m")
    replaced = gaps.withColumnRenamed("word", "a").join(other, ["at", "h", "m"]).filter(
        (F.col("a") < F.col("b")) & (F.col("m") > DEPTH)).select("a", "b")
    whole = long.select("word", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.xxhash64(F.concat(_slice("word", F.lit(0), i), _slice("word", i + 1)))))).alias("h"))
    short = long.select(F.col("word").alias("a"), F.xxhash64("word").alias("h"))
    shortened = whole.withColumnRenamed("word", "b").join(short, "h").filter(F.length("b") > DEPTH).select("a", "b")
    return replaced.unionByName(shortened).filter(F.levenshtein("a", "b", 1) == 1).distinct()


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b): every pair of distinct ``word`` that differ by one inserted, deleted or replaced code point, once."""
    return _through_trie(words.filter(F.length("word") <= DEPTH)).unionByName(_through_deletions(words))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each word: word, form, root, n, n_near and form_n.

    ``form`` is the most frequent neighbour (ties: the smallest) if it occurs RATIO times as often as the word, ``root``
    the end of the path of forms; a word without neighbours has n_near 0. NULL and empty texts have no
    words, repeated rows count each, very long texts and runs count whole, an empty table gives an empty
    result, other columns are ignored. Frequencies grow along a path of forms, so it ends; each round doubles the
    steps that a word has taken.
    """
    words = stored(word_counts(docs, key, text), "spelling-words")
    pairs = neighbours(words.select("word"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.toDF("b", "m"), "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("o"), F.col("b").alias("f"))).alias("x"))
    form = (-F.col("x.o") >= RATIO * F.col("n"))
    table = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("x.f")).alias("form"),
        F.when(form, -F.col("x.o")).cast("long").alias("form_n")), "spelling-forms")
    paths = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = paths.toDF("root", "_next")
        paths = stored(paths.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        if paths.filter("moved").isEmpty():
            break
        paths = paths.drop("moved")
    return table.join(paths.drop("moved"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
