"""Files as rows: scans, decoding, Markdown sections, page heuristics, tables, HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftwell.functions import text as T


def scan(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*",), recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content, file_type) of files that match a pattern, each once; files of no bytes give no row."""
    read = lambda p: spark.read.format("binaryFile").option("pathGlobFilter", p).option("recursiveFileLookup", str(recursive).lower()).load(root)
    files = reduce(DataFrame.unionByName, map(read, patterns))
    return (files if len(patterns) == 1 else files.dropDuplicates(["path"])).withColumn("file_type", T.file_type(F.col("path")))


def loader(kind: str):
    if kind != "local":
        raise ValueError(f"unknown source: {kind}")
    return scan


def without_bad_bytes(content: Column) -> Column:
    """UTF-8, bytes that aren't dropped (and with them replacement characters)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


#: Parsers by file type; any other type is plain text.
PARSERS = {"md": "markdown", "html": "html", "htm": "html", "csv": "csv", "json": "json"}


def parser_of(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv]), kind), F.lit("text"))


def parsed(files: DataFrame) -> DataFrame:
    """files (path, content, file_type) with parser, and text as that parser gives it: HTML without its tags, all else as decoded."""
    out = files.withColumn("parser", parser_of(F.col("file_type"))).withColumn("text", decoded(F.col("content")))
    return out.withColumn("text", F.when(F.col("parser") == "html", html_text(F.col("text"))).otherwise(F.col("text")))


def merged_pages(pages: DataFrame, by: str, page: str, text: str = "text", tables: str | None = None, marks: bool = True) -> DataFrame:
    """(by, content): a document's pages in order, each under a mark; tables (array of texts of each page) follow their page."""
    mark = F.concat(F.lit("\n\n--- Page "), F.col(page).cast("string"), F.lit(" ---\n\n")) if marks else F.lit("")
    more = F.array_join(F.transform(F.coalesce(tables, F.array().cast("array<string>")), lambda t: F.concat(F.lit("\n\n[TABLE]\n"), t, F.lit("\n"))), "") if tables else F.lit("")
    own = F.struct(F.col(page).alias("page"), F.concat(mark, F.coalesce(text, F.lit("")), more).alias("t"))
    return pages.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x.t), "").alias("content"))


def table_as(rows: Column, strategy: str, most_rows: int = 100, most_columns: int = 20) -> Column:
    """struct(type, content) of a table (array of rows of cells): none, preserve (its rows as JSON), markdown or separate (plain text)."""
    cut = F.transform(F.slice(rows, 1, most_rows), lambda r: F.slice(r, 1, most_columns))
    made = {
        "none": ("none", F.lit(None).cast("string")), "preserve": ("structured", F.to_json(cut)),
        "markdown": ("markdown", markdown_table(rows, most_rows, most_columns)), "separate": ("separate_chunk", plain_table(cut)),
    }
    if strategy not in made:
        raise ValueError(f"unknown table strategy: {strategy}")
    kind, content = made[strategy]
    return F.struct(F.lit(kind).alias("type"), content.alias("content"))


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes aren't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def sections(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, section, level, title, content): cut at Markdown headings; what stands before the first has no title.

    Lines are numbered by their place in the text, sections by a running count within a document.
    """
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    head = F.col("line").rlike(r"^#{1,6}\s+")
    numbered = lines.withColumn("section", F.sum(head.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))).withColumn("head", head)
    out = numbered.groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("head"), F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)))).alias("level"),
        F.max(F.when(F.col("head"), T.strip(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x.line), "\n").alias("content"),
    )
    return out.withColumn("content", T.strip(F.col("content"))).where((F.col("title").isNotNull()) | (F.col("content") != ""))


def without_footer(text: Column) -> Column:
    """Without a last line of under 50 characters, even if it is the only one."""
    lines = F.split(text, "\n")
    return F.when(F.char_length(T.strip(F.element_at(lines, -1))) < 50, F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n")).otherwise(text)


def without_page_number(text: Column, page: Column) -> Column:
    n = page.cast("string")
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~T.strip(x).isin(n, F.concat(F.lit("Page "), n), F.concat(F.lit("page "), n))), "\n")


def headers(text: Column) -> Column:
    """array of struct(text, line) of lines that look like headings."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(T.strip(x).alias("text"), i.alias("line")))
    upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    return F.filter(
        lines,
        lambda x: (x.text != "") & (F.char_length(x.text) <= 120)
        & (upper(x.text) | x.text.rlike("^(CHAPTER|SECTION)") | (x.text.rlike(r"^\d") & (F.size(T.split_words(x.text)) <= 6))),
    )


def markdown_table(rows: Column, most_rows: int = 100, most_columns: int = 20) -> Column:
    """A table (array of rows of cells) in Markdown, its first row as the header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(r, 1, most_columns), " | ", "None"), F.lit(" |"))
    kept = F.slice(rows, 1, most_rows)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.slice(kept[0], 1, most_columns), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.array(line(kept[0]), rule), F.transform(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), line)), "\n"))


def plain_table(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "None")), "\n")


def html_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments out, tags as spaces, white space collapsed (an extension)."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
