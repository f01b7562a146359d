"""Line dedup by prefix doubling over line sequences; DataFrame functions only.

A text is its sequence of lines (cut at each line feed); lines without a word are kept and not part of the sequence. A
line is deleted if it lies in a run of consecutive lines, ``min_words`` words or more together, that also starts at an
earlier place: a smaller (doc_id, row, line), within the same text or another.

The suffix array. Ranks of suffixes by their first line come from the sorted distinct lines that occur twice or more, and
ranks by 2^(k+1) lines from the sorted distinct pairs of ranks by 2^k lines, as in prefix doubling; what occurs once is
discarded at once, since no repeat can contain it. A rank is the position in a global sort (range-partitioned), so equal
ranks are one interval of suffixes with a common prefix of at least 2^k lines.

Which intervals decide. Every qualifying run is the union of its shortest qualifying windows, the one that starts at each
of its lines and the one that ends there; each is at most ``min_words`` lines long. So doubling ends once 2^k reaches the
longest such window. The interval of a window of n lines is given by two ranks of overlapping blocks of 2^k <= n lines,
the first and the last; all of an interval but its first place are later copies, and their lines go. Adjacent windows
join up to the maximal repeated runs.

Skew: a line, or a copied text, that makes up a third of all rows only meets per-key counts and minima (combined before
the shuffle) and joins of unsalted keys that adaptive execution may split; no window or list is keyed by content. The
only lists are those of one text.

Defined cases: null text: kept as null, no lines. Empty text: one line without words. Very long texts: lines of one text
are rows like any others; only its places that go are one list. Repeated rows: all but the first lose what qualifies.
Null doc_id: comes before all others. Rows with the same doc_id: in order of file and place. Empty table: empty result.
Other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.llm.common import dropped, numbered, place, table, written

#: Words that a repeated run has at least.
MIN_WORDS = 8
WORD = r"[^\x20\x09-\x0D]+"
_ROW, _LINES, _GONE = "row", "own_lines", "gone"


def _worded(line: Column) -> Column:
    return line.rlike(WORD)


def lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, idx (place among the text's lines with words), pos (among all), a, b (96-bit hash of the line), words."""
    placed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    own = docs.select(_ROW, F.col("doc_id").cast("long"), F.filter(placed, lambda x: _worded(x["line"])).alias("own"))
    return own.select(_ROW, "doc_id", F.posexplode("own").alias("idx", "l")).select(
        _ROW, "doc_id", "idx", "l.pos", "l.line"
    ).select(
        _ROW,
        "doc_id",
        "idx",
        "pos",
        F.xxhash64("line").alias("a"),
        F.hash("line").alias("b"),
        F.regexp_count("line", F.lit(WORD)).alias("words"),
    )


def ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """The distinct ``by`` that occur twice or more, with their rank in a global sort."""
    repeated = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    return written(repeated.orderBy(*by).select(*by, F.monotonically_increasing_id().alias("rank")), "ranks")


def doubled(level: DataFrame, step: int) -> DataFrame:
    """From ranks by ``step`` lines to ranks by twice as many: row, idx, rank of what still occurs twice."""
    ahead = level.select(_ROW, (F.col("idx") - step).alias("idx"), F.col("rank").alias("after"))
    pairs = written(level.select(_ROW, "idx", F.col("rank").alias("before")).join(ahead, [_ROW, "idx"]), "pairs")
    return pairs.join(ranked(pairs, ["before", "after"]), ["before", "after"]).select(_ROW, "idx", "rank")


def windows(places: DataFrame, min_words: int) -> DataFrame:
    """row, doc_id, idx, n: the shortest windows of ``min_words`` words that start, and that end, at each repeated line."""
    by = Window.partitionBy(_ROW).orderBy("idx")
    near = F.struct("idx", "words")
    ahead = F.collect_list(near).over(by.rowsBetween(0, min_words - 1))
    behind = F.collect_list(near).over(by.rowsBetween(-(min_words - 1), 0))

    def shortest(around: Column) -> Column:
        """Lines until there are min_words words without a gap; null if there are too few."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(False).alias("gap"))

        def step(s: Column, x: Column) -> Column:
            gap = s["gap"] | (F.abs(x["idx"] - F.col("idx")) != s["n"])
            take = ~gap & (s["words"] < min_words)
            return F.struct(
                (s["n"] + take.cast("int")).alias("n"),
                (s["words"] + F.when(take, x["words"]).otherwise(0)).alias("words"),
                (gap & (s["words"] < min_words)).alias("gap"),
            )

        return F.aggregate(around, start, step, lambda s: F.when(s["words"] >= min_words, s["n"]))

    spread = places.select(_ROW, "doc_id", "idx", "words", ahead.alias("ahead"), F.reverse(behind).alias("behind"))
    sized = spread.select(_ROW, "doc_id", "idx", shortest(F.col("ahead")).alias("f"), shortest(F.col("behind")).alias("b"))
    both = F.array_distinct(
        F.array(
            F.struct(F.col("idx").alias("at"), F.col("f").alias("n")),
            F.struct((F.col("idx") - F.col("b") + 1).alias("at"), F.col("b").alias("n")),
        )
    )
    found = sized.select(_ROW, "doc_id", F.explode(F.filter(both, lambda x: x["n"].isNotNull())).alias("w"))
    return found.select(_ROW, "doc_id", F.col("w.at").alias("idx"), F.col("w.n").alias("n")).distinct()


def deleted(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row, its lines that go: of each row of docs (with its row number) that loses lines, the places of those that go."""
    every = written(lines(docs), "lines")
    places = written(every.join(ranked(every, ["a", "b"]), ["a", "b"]).select(_ROW, "doc_id", "idx", "pos", "words", "rank"), "places")
    wanted = written(windows(places, min_words), "windows")
    longest = wanted.agg(F.max("n")).first()[0] or 1
    levels, step = [places.select(_ROW, "idx", "rank")], 1
    while 2 * step <= longest:
        levels.append(written(doubled(levels[-1], step), "level"))
        step *= 2
    ranks = reduce(DataFrame.unionAll, [x.withColumn("k", F.lit(k)) for k, x in enumerate(levels)])
    k = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")
    keyed = wanted.withColumn("k", k).withColumn("last", F.expr("idx + n - cast(shiftleft(1, k) as int)"))
    keyed = keyed.join(ranks.withColumnRenamed("rank", "head"), [_ROW, "idx", "k"])
    tails = ranks.select(_ROW, F.col("idx").alias("last"), "k", F.col("rank").alias("tail"))
    keyed = written(keyed.join(tails, [_ROW, "last", "k"]).select(_ROW, "doc_id", "idx", "n", "head", "tail"), "intervals")
    dropped(every, wanted, *levels[1:])
    first = keyed.groupBy("n", "head", "tail").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", _ROW, "idx")).alias("first")
    )
    first = first.where("copies > 1").select(
        "n", "head", "tail", F.col(f"first.{_ROW}").alias("first_row"), F.col("first.idx").alias("first_idx")
    )
    # a table of its own, so that the join below has a shuffle to itself and a large interval can be split
    first = written(first, "first")
    later = keyed.join(first, ["n", "head", "tail"]).where(
        (F.col(_ROW) != F.col("first_row")) | (F.col("idx") != F.col("first_idx"))
    )
    gone = later.select(_ROW, F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("n") - 1)).alias("at"))
    placed = gone.distinct().join(places.select(_ROW, F.col("idx").alias("at"), "pos"), [_ROW, "at"])
    out = written(placed.groupBy(_ROW).agg(F.collect_set("pos").alias(_GONE)), "gone")
    dropped(places, keyed, first)
    return out


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """All rows and columns of docs, the text without deleted lines; ``report`` adds n_lines and n_removed."""
    base = numbered(docs)
    at, columns = place(docs, "text"), base.columns[:-1]
    own_id = F.col(columns[place(docs, "doc_id")]).cast("long").alias("doc_id")
    gone = deleted(base.select(_ROW, own_id, F.col(columns[at]).alias("text")), min_words)
    # the lines are cut below the join, so that the lambdas above it read an array that is there
    kept = [c for c in columns if c != columns[at]]
    cut = base.select(_ROW, *kept, F.split(columns[at], "\n").alias(_LINES))
    joined = cut.join(gone.hint("shuffle_hash"), _ROW, "left")
    own = F.col(_LINES)
    stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(_GONE))
    left = F.when(F.col(_GONE).isNull(), own).otherwise(F.transform(stay, lambda i: F.get(own, i)))
    out = [F.array_join(left, "\n").alias(c) if c == columns[at] else F.col(c) for c in columns]
    out = joined.select(
        *out,
        F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(_GONE), F.lit(0)).cast("long").alias("n_removed"),
    )
    return out.toDF(*docs.columns, "n_lines", "n_removed") if report else out.select(*columns).toDF(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup(docs, report=True).select("doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM d),
s AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
             row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, sum(b.words) OVER p AS total, sum(b.words) OVER p - b.words AS less,
             a.words AS head, string_agg(b.line, chr(10)) OVER p AS run
      FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.idx BETWEEN a.idx AND a.idx + 7
      WINDOW p AS (PARTITION BY a.doc_id, a.idx ORDER BY b.idx ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM w
      WHERE total >= 8 AND (less < 8 OR total - head < 8)),
g AS (SELECT DISTINCT s.doc_id, s.pos FROM q JOIN s ON s.doc_id = q.doc_id AND s.idx BETWEEN q.i AND q.j WHERE q.nth > 1),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
             count(g.pos) AS n_removed
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
