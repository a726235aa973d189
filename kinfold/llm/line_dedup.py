"""Repeated runs of lines by a suffix array over line-ID sequences.

Lines that occur once part the documents: between them lie stretches of repeated lines, and only those of at
least min_words words can hold a repeated run. Their suffixes are ranked by their first line, then by their
first 2, 4, 8, ... lines (prefix doubling): the rank of a prefix of twice the length follows from the pair of
ranks of its halves. A rank is the number of suffixes whose prefix is smaller. What is asked is where suffixes
agree for min_words words, so the rounds end when the prefixes have as many: a suffix takes no part in rounds
beyond, and one whose prefix occurs once has no common prefix with any other and drops out.

A run of lines is told by the ranks of the two overlapping prefixes, a power of two long, that cover it. Runs
sorted by these ranks, then by position, are the suffix array at the depth of min_words: those with equal ranks
are an interval of suffixes whose longest common prefix has at least min_words words. The first one in the
order of positions stays.

A line is part of a run that an earlier position has too if, and only if, one of two kinds of runs occurs
earlier: the shortest one of min_words words from some line up to it on, or the shortest that ends with it.
(Where the longer run has as many words up to the line, it holds the second kind; else the first kind, taken
from where it begins, reaches the line.) So the deleted lines are those of the longest match of each suffix
with any earlier position, though no match is followed to its end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import HOT_KEYS, HOT_ROWS, free_name, hot_join, passing, row_key, stage, word_count
from kinfold.llm.running import running_sums

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """lines (row, i, h1, h2, words) -> (row, stretch, i, rank, before, words, end) of the lines in stretches of at least min_words words.

    rank is the place of the line among all repeated ones, equal lines having the same; before are the
    words of the stretch before it, end is the line behind the stretch.
    """
    keys = stage(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    ranked = stage(running_sums(keys, [], [F.col("h1"), F.col("h2")], {"upto": F.col("n")}, "names").select("h1", "h2", (F.col("upto") - F.col("n")).alias("rank")), "ranks")
    known = hot_join(lines, ranked, ["h1", "h2"], keys).select("row", "i", "rank", "words")
    # within a stretch lines and their numbers among the repeated ones go up together
    known = known.withColumn("stretch", F.col("i") - F.row_number().over(Window.partitionBy("row").orderBy("i")))
    own = Window.partitionBy("row", "stretch")
    so_far = F.sum("words").over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    known = known.withColumns({"before": so_far, "all": F.sum("words").over(own), "end": F.max("i").over(own) + 1})
    return known.where(F.col("all") >= min_words).drop("all")


def shortest_runs(known: DataFrame, min_words: int) -> DataFrame:
    """(row, i, n): the shortest runs of at least min_words words from a line on, and up to a line, n lines each."""
    # one more mark stands for the end of the stretch
    mark, end = F.struct("i", "before"), F.struct(F.col("end").alias("i"), (F.col("before") + F.col("words")).alias("before"))
    marks = F.when(F.col("i") + 1 == F.col("end"), F.array(mark, end)).otherwise(F.array(mark))
    marks = known.select("row", "stretch", F.explode(marks).alias("m")).select("row", "stretch", "m.*")
    own = Window.partitionBy("row", "stretch")
    # lines without words leave before as it is: the nearest end and the nearest beginning are taken
    ahead = F.min("i").over(own.orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -min_words))
    back = F.max("i").over(own.orderBy("before").rangeBetween(Window.unboundedPreceding, -min_words))
    found = marks.withColumns({"to": ahead, "from": back})
    runs = F.array(F.struct(F.col("i").alias("i"), (F.col("to") - F.col("i")).alias("n")), F.struct(F.col("from").alias("i"), (F.col("i") - F.col("from")).alias("n")))
    return found.select("row", F.explode(runs).alias("r")).select("row", "r.*").where("n is not null").distinct()


def doubled_ranks(known: DataFrame, runs: DataFrame) -> DataFrame:
    """(row, i, k, rank): the ranks of suffixes by their first 2**k lines, as far as runs ask. Beyond one line those that occur once are left out."""
    most = runs.agg(F.max("n")).first()[0] or 0
    asked = runs.groupBy("row").agg(F.max("n").alias("most"))
    last = stage(known.join(asked, "row").select("row", "i", "rank", "most"), "ranks")
    table, k = last.select("row", "i", F.lit(0).alias("k"), "rank"), 0
    while 2 << k <= most:
        half = last.where(F.col("most") >= 2 << k)
        ahead = last.select("row", (F.col("i") - (1 << k)).alias("i"), F.col("rank").alias("next"))
        pairs = stage(half.join(ahead, ["row", "i"]), "pairs")
        counts = stage(pairs.groupBy("rank", "next").agg(F.count("*").alias("n")), "counts")
        names = running_sums(counts, ["rank"], [F.col("next")], {"upto": F.col("n")}, "names").where("n > 1")
        names = stage(names.select("rank", "next", (F.col("rank") + F.col("upto") - F.col("n")).alias("new")), "names")
        k += 1
        last = stage(hot_join(pairs, names, ["rank", "next"], counts).select("row", "i", F.col("new").alias("rank"), "most"), "ranks")
        table = table.unionByName(last.select("row", "i", F.lit(k).alias("k"), "rank"))
    return table


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k1, k2, copies, n_removed, cuts of the rows of docs that lose lines.

    k1 and k2 tell rows by doc_id and text. Of the copies of a row that agree in both, cuts (first, last)
    holds the deleted lines of the first one, in order and apart from each other; the others lose all
    of theirs if they have min_words words.
    """
    line = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.hash(x, F.lit(7)).alias("h2"), word_count(x).alias("words"))
    k1, k2 = row_key(docs, ["doc_id", "text"])
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.transform(_lines(F.col("text")), line).alias("lines"))
    rows = rows.withColumn("words", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["words"])).where(F.col("words") >= min_words)
    with passing(docs.sparkSession):
        # written, so that the numbers stay
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "line-ids")
        lines = rows.select("row", F.posexplode("lines").alias("i", "x")).select("row", "i", "x.*")
        known = stage(stretches(lines, min_words), "stretches")
        runs = stage(shortest_runs(known, min_words), "runs")
        levels = doubled_ranks(known, runs).select("row", F.col("i").alias("at"), "k", "rank")
        told = runs.withColumn("k", F.length(F.bin("n")) - 1)
        for name, at in (("r1", F.col("i")), ("r2", F.expr("cast(i + n - shiftleft(1, k) as int)"))):
            told = told.withColumn("at", at).join(levels.withColumnRenamed("rank", name), ["row", "at", "k"]).drop("at")
        # the suffix array: runs by rank, then by position; in each interval the first one stays
        order = [F.col("doc_id").asc_nulls_first(), F.col("k1"), F.col("row"), F.col("i")]
        array = told.join(rows.select("row", "doc_id", "k1"), "row").select("row", "doc_id", "k1", "i", "n", "r1", "r2")
        array = running_sums(stage(array, "array"), ["n", "r1", "r2"], order, {"nth": F.lit(1)}, "array")
        later = array.where("nth > 1").select("row", "i", (F.col("i") + F.col("n")).alias("e"))
        # those of a row, joined where they touch
        by_start = Window.partitionBy("row").orderBy("i", "e")
        reach = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
        islands = later.withColumn("new", F.coalesce((F.col("i") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        spans = islands.groupBy("row", "island").agg(F.min("i").alias("first"), (F.max("e") - 1).alias("last"))
        cuts = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cuts"), F.sum(F.col("last") - F.col("first") + 1).alias("n_removed"))
        copies = rows.groupBy("k1", "k2").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
        found = copies.join(cuts, "row", "left").where("copies > 1 or cuts is not null")
        return stage(found.select("k1", "k2", "copies", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "cuts"), "cuts", keep=True)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, the text without later copies of repeated runs, and n_lines and n_removed.

    Lines end at line feeds and are equal byte for byte; a run counts if it has at least min_words words
    (between ASCII white space), in one document or several. Every later occurrence loses the lines of its
    longest match with any earlier one, even where that overlaps itself or is cut itself: a line over and
    over stays once, and what is left may be the rest of runs that began elsewhere. Order is that of
    doc_id, nulls first, then of a hash of the row. Null texts stay null, with one line and none removed;
    so are empty ones. Repeated rows are copies like any other: of those that agree in doc_id and text one
    is the first, whichever. An empty table gives an empty result. A text of which everything is removed
    is empty. Where docs has a column of the name n_lines or n_removed, the new one gets a leading "_".
    """
    if min_words < 1:
        raise ValueError("a run has at least one word")
    runs = repeated_runs(docs, min_words)
    a, b, cuts, removed, copies, nth, number = (free_name(docs, c) for c in ("_k1", "_k2", "_cuts", "_removed", "_copies", "_nth", "_number"))
    k1, k2 = row_key(docs, ["doc_id", "text"])
    found = runs.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("copies").alias(copies), F.col("n_removed").alias(removed), F.col("cuts").alias(cuts))
    # rows with too few words for a run stay where they are
    few = F.coalesce(word_count(F.col("text")), F.lit(0)) < min_words
    rows = docs.where(~few).withColumns({a: k1, b: k2})
    # rows that occur so often that one task should not number them: fewer than HOT_KEYS
    bound = (runs.agg(F.sum("copies")).first()[0] or 0) // HOT_KEYS + HOT_ROWS
    hot = found.where(F.col(copies) > bound)
    parts = []
    if some := hot.select(a, b).collect():
        keys = F.broadcast(docs.sparkSession.createDataFrame(some, rows.select(a, b).schema))
        often = stage(rows.join(keys, [a, b], "left_semi").withColumn(number, F.monotonically_increasing_id()), "often")
        first = often.groupBy(a, b).agg(F.min(number).alias(number)).withColumn(nth, F.lit(1)).drop(a, b)
        parts.append(often.join(F.broadcast(first), number, "left").withColumn(nth, F.coalesce(nth, F.lit(2))).drop(number).join(F.broadcast(hot), [a, b]))
        rows = rows.join(keys, [a, b], "left_anti")
    numbered = rows.withColumn(nth, F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(1))))
    # documents with cuts grow with the input: one plan at every size
    parts.insert(0, numbered.join(found.hint("merge"), [a, b], "left"))
    both = reduce(DataFrame.unionByName, parts)
    # between two cuts the lines stay: slices, not a test of each line against each cut
    lines = _lines(F.col("text"))
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["last"] + 1))
    ends = F.concat(F.transform(cuts, lambda c: c["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))
    text = F.when(F.col(nth) > 1, F.lit("")).when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    size = F.size(lines).cast("long")
    cut = both.withColumns({n_lines: size, n_removed: F.when(F.col(nth) > 1, size).otherwise(F.coalesce(removed, F.lit(0)).cast("long"))}).withColumn("text", text)
    plain = docs.where(few).withColumns({n_lines: size, n_removed: F.lit(0).cast("long")})
    names = [*docs.columns, n_lines, n_removed]
    return cut.select(*[F.col(f"`{c}`") for c in names]).unionByName(plain.select(*[F.col(f"`{c}`") for c in names]))
