"""Spelling variant grouping (12): letter-parity bitmask bands.

A word's mask has a bit for each letter, set if the word has the letter an odd number of times, and is split into three
bands of 30 letters. One inserted or deleted letter flips one bit, one replaced letter flips two; and the letter is one that
the word on that side has. So a word stands at its own bands and, for each of its letters, at those with the letter's bit
turned over, and two words are near only if they meet where all three bands and the length are equal:

  of words of one length, both stand there with a letter turned over, the one replaced and the one in its place;
  of words whose lengths differ by one, the longer stands there with the letter that the shorter has not.

The length filter is part of the key, and so is a sum over the letters that are left, which tells how often a letter
occurs where parity tells only odd from even. What remains is verified by the edit distance. Each pair meets once, and only
pairs that are near come out of the join. Built-in functions throughout.

Parity alone was tried first: joins on one equal band and the length took over 1,200 CPU seconds for half a gigabyte of
documents without an end, and all three bands with a letter turned over still left 620 million candidates for 374,000
words. The README has the figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: a to z and the characters from U+00C0 to U+00FF; letter i is in band i % 3, so that frequent ones are spread.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, FACTOR, NOISE = 7, 2, 10, 31
#: Words that meet by one key in one task; keys with more are dealt out.
GROUP = 2_000


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of every word: lower-cased runs of letters, of which one in `noise` by the checksum of id and run loses a
    letter; with at least min_length letters and min_count occurrences over all documents. Null texts have none, a null id
    is the empty string in the checksum, rows with one id count as they come.

    Occurrences are summed in the tasks first, so what is shuffled is words, whatever the number of documents.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= min_count) & (F.length("word") >= min_length))


def bit_of(c: Column) -> Column:
    """The bit of a character: those of LETTERS have one each, others share them by code point."""
    code = F.ascii(c)  # the code point of the first character
    return F.when(code.between(97, 122), code - 97).when(code.between(0xC0, 0xFF), code - (0xC0 - 26)).otherwise(code % len(LETTERS))


def flip(bands: Column, c: Column) -> Column:
    """Three bands with the bit of a character turned over."""
    i = bit_of(c)
    bit = F.call_function("shiftleft", F.lit(1), F.floor(i / 3).cast("int"))
    return F.array(*[F.when(i % 3 == b, bands[b].bitwiseXOR(bit)).otherwise(bands[b]) for b in range(3)])


def share(c: Column) -> Column:
    """What a character adds to a word's sum: 44 bits, so that the sum of any word's fits."""
    return F.xxhash64(c).bitwiseAND((1 << 44) - 1)


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b, n_a, n_b) of all unordered pairs of words (a stored table of word, n; words once each) at edit distance 1.

    Keys of over `group` words are dealt out: each word goes to one of their blocks of rows and meets the words of all
    blocks there, a block in a task.
    """
    split = words.select("word", "n", F.length("word").alias("len"), F.filter(F.split("word", ""), lambda c: c != "").alias("c"))
    sums = F.aggregate("c", F.lit(0).cast("long"), lambda acc, c: acc + share(c))
    masked = materialize(split.select("word", "n", "len", F.array_distinct("c").alias("has"), F.aggregate("c", F.array(*[F.lit(0)] * 3), flip).alias("m"), sums.alias("sum")), "masks")

    def place(bands: Column, length: Column, sum_: Column, turned: Column) -> Column:
        high = F.shiftleft(length.cast("long"), 30).bitwiseOR(bands[0].cast("long"))
        return F.struct(high.alias("k1"), F.shiftleft(bands[1].cast("long"), 30).bitwiseOR(bands[2].cast("long")).alias("k2"), sum_.alias("sum"), turned.alias("turned"))

    own = F.array(place(F.col("m"), F.col("len") + 1, F.col("sum"), F.lit("")))
    turned = F.transform("has", lambda c: place(flip(F.col("m"), c), F.col("len"), F.col("sum") - share(c), c))
    on = ["k1", "k2", "sum"]
    left = masked.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(turned).alias("k")).select("a", "n_a", *[f"k.{c}" for c in on], F.col("k.turned").alias("c_a"))
    right = masked.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.concat(own, turned)).alias("k")).select("b", "n_b", *[f"k.{c}" for c in on], F.col("k.turned").alias("c_b"))
    large = materialize(right.groupBy(*on).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group), "large-groups")
    if large.isEmpty():
        met = left.join(right, on)
    else:
        blocks = F.ceil(F.coalesce("size", F.lit(0)) / group).cast("int")
        right = right.join(large, on, "left").withColumn("block", F.when(blocks > 1, F.pmod(F.hash("b"), blocks)).otherwise(0)).drop("size")
        left = left.join(large, on, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))))).drop("size")
        met = left.join(right, [*on, "block"])
    longer, replaced = F.col("c_b") == "", (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b"))
    return met.where((longer | replaced) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


def followed(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): following forms from a word to the last. Each round doubles the steps made; as
    a form has FACTOR times the occurrences of its word, a chain has at most 18 steps and five rounds are enough."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = now.join(ahead, "root", "left")
        if joined.where("_next IS NOT NULL").isEmpty():
            return now
        now = materialize(joined.select("word", F.coalesce("_next", "root").alias("root")), "roots")


def variants(words: DataFrame, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of words (word, n; words once each, null words are dropped).

    form: of the words one letter away the most frequent, of equally frequent ones the first in code-point order, if it has
    at least factor times the occurrences; root: where forms lead to. An empty table gives an empty one.
    """
    words = materialize(words.where("word IS NOT NULL").select("word", "n"), "words")
    pairs = near_pairs(words, group)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")),
    )).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    known = words.join(best, "word", "left")
    near = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best")).alias("best")), "near")
    near = near.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))
    roots = followed(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(noisy_words(table(spark, sf_dir, "documents")))


#: crc32 byte by byte; letters beyond ASCII are two bytes. DuckDB's levenshtein counts bytes, so it gets a byte a letter.
OP12_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY id, run
), bytes AS (
  SELECT id, run, c, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END)) AS b FROM counted
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), spelled AS (
  SELECT word, n, length(word) AS len, array_to_string(list_transform(string_split(word, ''), lambda x: CASE WHEN unicode(x) < 128 THEN x ELSE chr((unicode(x) - 192 + 32)::INT) END), '') AS s FROM words
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM spelled a JOIN spelled b ON abs(a.len - b.len) <= 1 AND a.word <> b.word AND levenshtein(a.s, b.s) = 1
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form, word AS at, form AS next FROM forms
  UNION ALL
  SELECT c.word, c.form, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c USING (word) WHERE c.next IS NULL
"""
