"""Statistics of whole texts as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: white space, symbols, the repetition window.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def _distinct_lost(array: Column) -> Column:
    return F.size(array) - F.size(F.array_distinct(array))


#: Up to so many different repeated windows they are looked up one by one; beyond that all windows are sorted.
_FEW = 32


def _places(prints: Column) -> Column:
    """Places of the elements that occur twice or more, in order, by sorting elements with their places."""
    pairs = F.sort_array(F.transform(prints, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same_as_next = F.zip_with(pairs, F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False)))
    same_as_last = F.concat(F.array(F.lit(False)), same_as_next)
    repeated = F.zip_with(same_as_next, same_as_last, lambda a, b: F.coalesce(a, F.lit(False)) | b)
    return F.sort_array(F.filter(F.zip_with(pairs, repeated, lambda a, r: F.when(r, a["i"])), lambda x: x.isNotNull()))


def _repeated(prints: Column) -> Column:
    """The different elements that occur twice or more."""
    ordered = F.sort_array(prints)
    return F.array_distinct(F.filter(F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))


def _covered(places: Column) -> Column:
    """Words that the windows at these places cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(places, zero, lambda s, x: F.struct((s["n"] + x + WINDOW - F.greatest(x, s["upto"])).alias("n"), (x + WINDOW).alias("upto")), lambda s: s["n"])


def _beside(hashes: Column, step: int) -> Column:
    """Hashes of each element with the one ``step`` places on; as many as there are such pairs."""
    ahead = F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0)))
    return F.zip_with(F.slice(hashes, 1, F.size(ahead)), ahead, lambda a, b: F.xxhash64(a, b))


def spaced(text: Column) -> Column:
    """The text with every white-space character as a space."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct`` (long) to rows with ``text``; null texts count as empty.

    Words are hashed once; the hash of 2, 4 and 8 words is made of those of the halves, as long as enough of these occur again: a window of 8 words that does makes at least 8 words, 7
    pairs and 5 fours do.
    """
    text = F.coalesce("text", F.lit(""))
    kept = docs.columns
    docs = docs.withColumn("_split", F.split(spaced(text), " "))
    docs = docs.withColumn("_words", F.transform(F.array_remove("_split", ""), lambda w: F.xxhash64(w))).withColumn("_spaces", F.size("_split") - 1).drop("_split")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    docs = docs.withColumns({"_symbols": F.regexp_count(text, F.lit(SYMBOLS)), "_lines": F.when(F.contains(text, F.lit("\n")), _distinct_lost(lines)).otherwise(0), "_chars": F.length(text)})
    none = F.array().cast("array<bigint>")
    docs, step = docs.withColumn("_prints", F.col("_words")), 1
    while step < WINDOW:
        docs = docs.withColumn("_prints", F.when(_distinct_lost(F.col("_prints")) > WINDOW - step, _beside(F.col("_prints"), step)).otherwise(none))
        step *= 2
    docs = docs.withColumn("_again", F.when(_distinct_lost(F.col("_prints")) > 0, _repeated(F.col("_prints"))))
    few = F.filter(F.transform("_prints", lambda x, i: F.when(F.array_contains("_again", x), i)), lambda x: x.isNotNull())
    docs = docs.withColumn("_places", F.when(F.size("_again") <= _FEW, few).when(F.size("_again") > _FEW, _places(F.col("_prints"))))
    return docs.select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in kept],
        F.size("_words").cast("long").alias("n_words"),
        (F.col("_chars") - F.col("_spaces")).cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_lines").cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_places")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )


def shape_statistics(docs: DataFrame) -> DataFrame:
    """Adds statistics of the text's shape (double, never null) to rows with ``text``; null and empty texts have zeros. Names begin with ``s_``, and columns of these names are replaced."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_split", F.split(spaced(text), " "))
    rows = rows.withColumns({"_words": F.transform(F.array_remove("_split", ""), lambda w: F.xxhash64(w)), "_spaces": F.size("_split") - 1}).drop("_split")
    rows = rows.withColumn("_chars", F.length(text)).withColumn("_n", F.size("_words")).withColumn("_distinct", F.size(F.array_distinct("_words"))).withColumn("_lines", F.col("_chars") - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    chars, n = F.greatest("_chars", F.lit(1)), F.greatest("_n", F.lit(1))

    def count(*signs: str) -> Column:
        rest = text
        for c in signs:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return F.col("_chars") - F.length(rest)

    next_same = F.size(F.filter(F.zip_with("_words", F.slice("_words", 2, F.greatest(F.col("_n") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    found = {
        "s_log_words": F.log1p("_n"),
        "s_word_length": (F.col("_chars") - F.col("_spaces")) / n,
        "s_symbols": F.regexp_count(text, F.lit("[#*$%&|<>!]")) / chars,
        "s_pipes": count("|") / n,
        "s_shouts": count("!") / n,
        "s_upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "s_digits": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "s_stops": count(".", "?") / n,
        "s_commas": count(",") / n,
        "s_distinct": F.col("_distinct") / n,
        "s_variety": F.log1p("_distinct") / F.log1p(n),
        "s_next_same": next_same / n,
        "s_line_words": F.log1p(F.col("_n") / F.greatest("_lines", F.lit(1))),
    }
    return rows.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in found.items()}).drop("_words", "_spaces", "_chars", "_n", "_distinct", "_lines")
