"""From ranked rows to a context: budget, order, format and truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T


def budget(rows: DataFrame, most: int, tokens: Column | None = None) -> DataFrame:
    """The longest prefix of each query's rows whose tokens sum to most at most, with the running sum."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("tokens", (F.size(T.words("text")) if tokens is None else tokens).cast("long"))
    return counted.withColumn("running", F.sum("tokens").over(w)).where(F.col("running") <= most)


def lost_in_middle(rows: DataFrame) -> DataFrame:
    """rows with position: ranks 1, 3, 5, ... from the left, 2, 4, 6, ... from the right."""
    i, n = F.col("rank") - 1, F.count("*").over(Window.partitionBy("query_id"))
    return rows.withColumn("position", F.when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor((i - 1) / 2)).cast("long"))


def chronological(rows: DataFrame, date: Column, item: str = "doc_id") -> DataFrame:
    """rows with position: by date as text, missing ones first, then by id."""
    w = Window.partitionBy("query_id").orderBy(F.coalesce(date.cast("string"), F.lit("")), F.col(item))
    return rows.withColumn("position", F.row_number().over(w) - 1)


def sources(rows: DataFrame, source: Column) -> DataFrame:
    """(query_id, sources): the distinct sources of each query's rows, in the order of their first rank."""
    first = rows.groupBy("query_id", source.alias("source")).agg(F.min("rank").alias("rank"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x.source).alias("sources"))


def snippet_lines(rows: DataFrame, source: Column, size: int = 200) -> DataFrame:
    """(query_id, context): a line "[rank] source: snippet" for each row, line ends as spaces."""
    line = F.format_string("[%d] %s: %s", "rank", source, F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), 1, size))
    return rows.select("query_id", F.struct("rank", line.alias("line")).alias("x")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.line), "\n").alias("context"))


#: Fixed value: what stands between the parts of a summary that was cut.
MARKER = "\n...[summary omitted due to length]...\n"


def truncate(text: Column | str, most: int, how: str = "truncate_end") -> Column:
    """At most `most` tokens (runs of white space count): end, middle (two fifths head), summarize_overflow, sliding_window."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    x = F.regexp_extract_all(t, F.lit(r"(\S+|\s+)"), F.lit(1))
    head = lambda n: F.array_join(F.slice(x, 1, n), "")
    tail = lambda n: F.array_join(F.slice(x, F.size(x) - (n - 1), F.lit(n)), "")
    two, five = int(most * 0.4), int(most * 0.5)
    out = {
        "truncate_end": head(most),
        "truncate_middle": F.concat(head(two), tail(most - two)),
        "summarize_overflow": F.concat(head(five), tail(most - five), F.lit(MARKER)),
        "sliding_window": tail(most),
    }[how]
    return F.when(F.size(x) <= most, t).otherwise(out)


def compress(text: Column | str, ratio: float) -> Column:
    """The first share of a text's words, one at least."""
    w = T.split_words(text)
    return F.array_join(F.slice(w, F.lit(1), F.greatest(F.floor(F.size(w) * ratio).cast("int"), F.lit(1))), " ")


#: Superscript digits.
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def citation(index: Column, source: Column, page: Column, how: str = "inline") -> Column:
    if how == "numbered":
        return F.format_string("[%d]", index)
    if how == "footnote":
        return F.translate(index.cast("string"), "0123456789", SUPERSCRIPTS)
    return F.concat(F.lit("([Source: "), F.coalesce(source, F.lit("Unknown")), F.lit(", page "), F.coalesce(page.cast("string"), F.lit("?")), F.lit("])"))


def source_header(index: Column, source: Column, page: Column, section: Column, date: Column) -> Column:
    """The line over a document of a context; a missing part is a question mark."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("["), index.cast("string"), F.lit("] [Source: "), F.coalesce(source, F.lit("Unknown")), F.lit(", page "), part(page), F.lit(", section "), part(section), F.lit(", "), part(date), F.lit("]"))


def issues(answer: Column, how: str, faithfulness: Column | None = None, threshold: float = 0.0, filters: dict[str, Column] | None = None) -> Column:
    """array of what is wrong with an answer: no citation of the form, too little faithfulness, filters that it triggers."""
    found = [F.when(~has_citation(answer, how), "No citations found")]
    if faithfulness is not None and threshold > 0:
        found.append(F.when(faithfulness < threshold, F.concat(F.lit("Low faithfulness: "), F.format_string("%.2f", F.bround(faithfulness, 2)))))
    found += [F.when(c, f"Content filter triggered: {k}") for k, c in (filters or {}).items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def has_citation(answer: Column, how: str = "inline") -> Column:
    return {"numbered": answer.rlike(r"\[\d+\]"), "inline": F.instr(F.lower(answer), "source:") > 0, "footnote": answer.rlike(r"[¹²³⁴⁵⁶⁷⁸⁹⁰]|\^\d+")}[how]
