"""Text, file, chunk and duplicate queries over documents, pages and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import privacy as P
from siftwell.functions import text as T
from siftwell.functions.stemming import stems
from siftwell.operators import chunking, context, dedup, language, records
from siftwell.operators.ingestion import Registry
from siftwell.plans.catalogue import query, table
from siftwell.sources import files
from siftwell.store import new_path

W = r"'[\p{L}\p{N}_]+'"
WORDS = rf"regexp_extract_all(lower(coalesce(text, '')), {W})"
SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x1c-\x1f\x{85}\p{Z}\x0b]+'), lambda x: x <> '')"
STRIP = r"'^[\s\x1c-\x1f\x{85}\p{Z}\x0b]+|[\s\x1c-\x1f\x{85}\p{Z}\x0b]+$'"
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, {STRIP}, '', 'g')), lambda x: x <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(T.ENGLISH + T.FRENCH))) + "]"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("tokenize_words", f"SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def tokenize_words(spark, sf_dir):
    w = T.words("text")
    return docs(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"))


@query("tokenize_whitespace", f"SELECT doc_id, len(w)::BIGINT AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {SPLIT} AS w FROM documents)")
def tokenize_whitespace(spark, sf_dir):
    w = T.split_words("text")
    return docs(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n_words"), F.md5(F.array_join(w, " ")).alias("words_md5"))


@query(
    "tokenize_ngrams",
    f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents)
    SELECT gram, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM t) GROUP BY gram""",
)
def tokenize_ngrams(spark, sf_dir):
    w = docs(spark, sf_dir).select(T.words("text").alias("w"))
    # A row for each word and the one after it, which a text's last word lacks; pairs are made from columns, which costs less than slices of the array.
    each = w.select(F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b")))).toDF("a", "b")
    grams = each.select(F.explode(F.array("a", F.concat("a", F.lit(" "), "b"))).alias("gram")).where(F.col("gram").isNotNull())
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


_STEM = "CASE " + " ".join(f"WHEN ends_with(t, '{s}') AND len(t) > {len(s) + 2} THEN t[:len(t) - {len(s)}]" for s in T.SUFFIXES) + " ELSE t END"


@query(
    "stem_suffix",
    f"SELECT {_STEM} AS stem, count(*) AS n FROM (SELECT unnest({WORDS}) AS t FROM documents) WHERE NOT list_contains({STOP}, t) GROUP BY 1",
)
def stem_suffix(spark, sf_dir):
    t = docs(spark, sf_dir).select(F.explode(T.without(T.words("text"), sorted(set(T.ENGLISH + T.FRENCH)))).alias("t"))
    return t.groupBy("t").agg(F.count("*").alias("c")).groupBy(T.stem(F.col("t")).alias("stem")).agg(F.sum("c").alias("n"))


@query("stem_porter")
def stem_porter(spark, sf_dir):
    """Words without English stop words, stemmed once each and counted by stem."""
    t = docs(spark, sf_dir).select(F.explode(T.without(T.words("text"), T.ENGLISH)).alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    return t.groupBy(stems(F.col("t")).alias("stem")).agg(F.sum("c").alias("n"))


@query("split_sentences", f"SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, chr(1))) AS sentences_md5 FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def split_sentences(spark, sf_dir):
    s = T.sentences("text")
    return docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "\x01")).alias("sentences_md5"))


def _re(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', {by}, 'g')"


_BASIC = _re(_re(_re(r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}\p{Cf}\p{Co}]', '', 'g')", r"\n{3,}", "chr(10) || chr(10)"), r"[\t\r\f\x0b]+", "' '"), " {2,}", "' '")


@query("clean_basic", f"SELECT doc_id, md5(lower(regexp_replace({_BASIC}, {STRIP}, '', 'g'))) AS clean_md5 FROM documents")
def clean_basic(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean("text", ["control", "newlines", "whitespace"], lower=True)).alias("clean_md5"))


_STRIPPED = _re(_re(_re("coalesce(text, '')", r"https?://[^\s\x0b]+|www\.[^\s\x0b]+", "''"), r"\b[\w.-]+@[\w.-]+\.[a-zA-Z]{2,}\b", "''"), r"\b\+?\d[\d\s()-]{7,}\d\b", "''")


@query("clean_pii_strip", f"SELECT doc_id, md5(regexp_replace({_STRIPPED}, {STRIP}, '', 'g')) AS clean_md5 FROM documents")
def clean_pii_strip(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean("text", ["urls", "emails", "phones"])).alias("clean_md5"))


_COMPAT = _re(r"regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f-\x{9f}\p{Cf}\p{Co}]', '', 'g')", " {2,}", "' '")


@query("clean_compat", f"SELECT doc_id, md5(regexp_replace({_COMPAT}, {STRIP}, '', 'g')) AS clean_md5 FROM documents")
def clean_compat(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean("text", ["control_all", "newlines", "whitespace"])).alias("clean_md5"))


@query("clean_punctuation", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}_\s\x0b]', '', 'g'), {STRIP}, '', 'g')) AS clean_md5 FROM documents")
def clean_punctuation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean("text", ["punctuation"])).alias("clean_md5"))


@query(
    "remove_stopwords",
    f"SELECT doc_id, md5(array_to_string(list_filter({SPLIT}, lambda x: NOT list_contains({STOP}, lower(x))), ' ')) AS kept_md5 FROM documents",
)
def remove_stopwords(spark, sf_dir):
    kept = F.filter(T.split_words("text"), lambda w: ~F.lower(w).isin(sorted(set(T.ENGLISH + T.FRENCH))))
    return docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(kept, " ")).alias("kept_md5"))


@query(
    "content_features",
    rf"""SELECT doc_id, len({SPLIT})::BIGINT AS n_words, length(coalesce(text, ''))::BIGINT AS n_characters, regexp_matches(coalesce(text, ''), '\|.*\|.*\|') AS has_tables,
    regexp_matches(coalesce(text, ''), '!\[.*?\]\(.*?\)') AS has_images, contains(coalesce(text, ''), '```') AS has_code FROM documents""",
)
def content_features(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", F.size(T.split_words("text")).cast("long").alias("n_words"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_characters"),
        T.has_tables("text").alias("has_tables"), T.has_images("text").alias("has_images"), T.has_code("text").alias("has_code"),
    )


_T = f"regexp_replace(coalesce(text, ''), {STRIP}, '', 'g')"


@query(
    "detect_title",
    rf"""WITH t AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '(?m)^#[ \t]+(\S.*)$', 1) AS h, regexp_replace(regexp_replace(string_split({_T}, chr(10))[1], '^#+', ''), {STRIP}, '', 'g') AS l FROM documents)
    SELECT doc_id, CASE WHEN h <> '' THEN regexp_replace(h, {STRIP}, '', 'g') WHEN l <> '' AND length(l) < 200 AND NOT contains(l, '.') THEN l ELSE 'doc-' || doc_id END AS title FROM t""",
)
def detect_title(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.title("text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"))


@query(
    "truncate_words",
    f"""SELECT doc_id, md5(CASE WHEN len(w) <= 32 THEN t ELSE array_to_string(w[1:32], ' ') END) AS head_md5, md5(CASE WHEN len(w) <= 32 THEN t ELSE array_to_string(w[len(w) - 31:], ' ') END) AS tail_md5,
    md5(CASE WHEN len(w) <= 32 THEN t ELSE array_to_string(w[1:16], ' ') || ' ... ' || array_to_string(w[len(w) - 15:], ' ') END) AS middle_md5 FROM (SELECT doc_id, coalesce(text, '') AS t, {SPLIT} AS w FROM documents)""",
)
def truncate_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[F.md5(T.truncate_words("text", 32, how)).alias(f"{name}_md5") for name, how in (("head", "start"), ("tail", "end"), ("middle", "middle"))])


@query(
    "document_metadata",
    f"""SELECT doc_id, source || '/' || doc_id || '.md' AS source_path, 'md' AS source_type, 'text/markdown' AS mime_type, lang AS language, len({SPLIT})::BIGINT AS n_words, 'default' AS tenant, 'draft' AS status, '1.0' AS version FROM documents""",
)
def document_metadata(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    kind = T.file_type(path)
    return docs(spark, sf_dir).select(
        "doc_id", path.alias("source_path"), kind.alias("source_type"), T.mime_type(kind).alias("mime_type"), F.col("lang").alias("language"), F.size(T.split_words("text")).cast("long").alias("n_words"),
        F.lit("default").alias("tenant"), F.lit("draft").alias("status"), F.lit("1.0").alias("version"),
    )


_KEYSTOP = "[" + ", ".join(f"'{w}'" for w in T.KEY_WORDS) + "]"


@query(
    "cache_keys",
    rf"""SELECT md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(text, '')), {STRIP}, '', 'g'), '[^\p{{L}}\p{{N}}_\s\x0b]', '', 'g'), '[\s\x1c-\x1f\x{{85}}\p{{Z}}\x0b]+'),
    lambda x: x <> '' AND NOT list_contains({_KEYSTOP}, x)), ' ')) AS key, count(*) AS n FROM conversations GROUP BY 1""",
)
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(T.cache_key("text").alias("key")).agg(F.count("*").alias("n"))


@query(
    "markdown_sections",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    h AS (SELECT *, regexp_matches(line, '^#{{1,6}}[\s\x0b]+') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
    o AS (SELECT doc_id, section::BIGINT AS section, max(CASE WHEN head THEN length(regexp_extract(line, '^(#{{1,6}})', 1)) END)::INT AS level, max(CASE WHEN head THEN regexp_replace(regexp_extract(line, '^#{{1,6}}[\s\x0b]+(.*)$', 1), {STRIP}, '', 'g') END) AS title,
    regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT head), ''), {STRIP}, '', 'g') AS content FROM s GROUP BY doc_id, section)
    SELECT doc_id, section, level, title, md5(content) AS content_md5 FROM o WHERE title IS NOT NULL OR content <> ''""",
)
def markdown_sections(spark, sf_dir):
    return files.sections(docs(spark, sf_dir)).select("doc_id", "section", "level", "title", F.md5("content").alias("content_md5"))


@query(
    "page_cleanup",
    rf"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), f AS (SELECT doc_id, CASE WHEN length(regexp_replace(l[-1], {STRIP}, '', 'g')) < 50 THEN l[1:len(l) - 1] ELSE l END AS l FROM t)
    SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: regexp_replace(x, {STRIP}, '', 'g') NOT IN ('1', 'Page 1', 'page 1')), chr(10))) AS page_md5 FROM f""",
)
def page_cleanup(spark, sf_dir):
    page = files.without_page_number(files.without_footer(F.coalesce("text", F.lit(""))), F.lit(1))
    return docs(spark, sf_dir).select("doc_id", F.md5(page).alias("page_md5"))


@query(
    "page_headers",
    rf"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), {STRIP}, '', 'g') AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents)
    SELECT doc_id, line::INT AS line, t AS header FROM l WHERE t <> '' AND length(t) <= 120 AND ((upper(t) = t AND lower(t) <> t) OR regexp_matches(t, '^(CHAPTER|SECTION)') OR (regexp_matches(t, '^[0-9]') AND len(regexp_split_to_array(t, '[\s\x1c-\x1f\x{{85}}\p{{Z}}\x0b]+')) <= 6))""",
)
def page_headers(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(files.headers(F.coalesce("text", F.lit("")))).alias("h")).select("doc_id", "h.line", F.col("h.text").alias("header"))


@query(
    "table_markdown",
    """SELECT n_nationkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' AS markdown, 'key | name' || chr(10) || n_nationkey || ' | ' || n_name AS plain FROM nation""",
)
def table_markdown(spark, sf_dir):
    cells = F.array(F.array(F.lit("key"), F.lit("name")), F.array(F.col("n_nationkey").cast("string"), F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", files.markdown_table(cells).alias("markdown"), files.plain_table(cells).alias("plain"))


@query("url_parts", r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    host, path = F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1), F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.lower(host).alias("host"), path.alias("path"))


@query("html_text")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


def _starts(n: str, size: int, step: int) -> str:
    return f"range(0, (ceil(greatest(0, {n} - {size}) / {step}) * {step})::BIGINT + 1, {step})"


@query(
    "chunk_fixed",
    f"""WITH t AS (SELECT doc_id, {SPLIT} AS w FROM documents), s AS (SELECT doc_id, w, unnest({_starts('len(w)', 128, 112)}) AS p FROM t WHERE len(w) > 0)
    SELECT doc_id, (p / 112)::INT AS chunk_index, p::INT AS start_token, least(p + 128, len(w))::INT AS end_token, md5(array_to_string(w[p + 1:p + 128], ' ')) AS content_md5 FROM s""",
)
def chunk_fixed(spark, sf_dir):
    return chunking.fixed(docs(spark, sf_dir), 128, 16).select("doc_id", "chunk_index", "start_token", "end_token", F.md5("content").alias("content_md5"))


@query(
    "chunk_sliding",
    f"""WITH t AS (SELECT doc_id, {SENTENCES} AS s FROM documents), c AS (SELECT doc_id, s, unnest(range(0, greatest(0, len(s) - 1 - 3) + 1)) AS i FROM t WHERE len(s) > 0)
    SELECT doc_id, i::INT AS chunk_index, md5(array_to_string(s[greatest(i - 3, 0) + 1:i + 4], ' ')) AS content_md5 FROM c WHERE i < len(s)""",
)
def chunk_sliding(spark, sf_dir):
    return chunking.sliding(docs(spark, sf_dir), 3, 1).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query(
    "chunk_parent_child",
    f"""WITH t AS (SELECT doc_id, {SPLIT} AS w FROM documents), p AS (SELECT doc_id, w, unnest({_starts('len(w)', 200, 180)}) AS s FROM t WHERE len(w) > 0),
    q AS (SELECT doc_id, (s / 180)::INT AS parent_index, w[s + 1:s + 200] AS w FROM p), r AS (SELECT *, unnest({_starts('len(w)', 50, 40)}) AS c FROM q)
    SELECT doc_id, parent_index, (c / 40)::INT AS child_index, doc_id || '_parent_' || parent_index || '_' || md5(array_to_string(w, ' ')[1:100])[1:8] AS parent_id, md5(array_to_string(w[c + 1:c + 50], ' ')) AS content_md5 FROM r""",
)
def chunk_parent_child(spark, sf_dir):
    return chunking.parent_child(docs(spark, sf_dir), (200, 20), (50, 10)).select("doc_id", "parent_index", "child_index", "parent_id", F.md5("content").alias("content_md5"))


@query(
    "chunk_sentences",
    f"""WITH t AS (SELECT doc_id, {SENTENCES} AS s FROM documents), c AS (SELECT doc_id, s, unnest(range(0, greatest(0, len(s) - 1 - 1) + 1)) AS i FROM t WHERE len(s) > 0)
    SELECT doc_id, i::INT AS chunk_index, md5(array_to_string(s[greatest(i - 1, 0) + 1:i + 2], ' ')) AS content_md5 FROM c WHERE i < len(s)""",
)
def chunk_sentences(spark, sf_dir):
    """By the strategy's name: windows of three sentences."""
    return chunking.chunk(docs(spark, sf_dir), "sentence_based").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("chunk_paragraphs")
def chunk_paragraphs(spark, sf_dir):
    return chunking.chunk(docs(spark, sf_dir), "paragraph_based", size=64, overlap=8)


@query(
    "chunk_sections",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    s AS (SELECT *, sum(regexp_matches(line, '^#{{1,6}}[\s\x0b]+')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l),
    o AS (SELECT doc_id, section::INT AS chunk_index, regexp_replace(string_agg(line, chr(10) ORDER BY pos), {{STRIP}}, '', 'g') AS content FROM s GROUP BY doc_id, section)
    SELECT doc_id, chunk_index, md5(content) AS content_md5 FROM o WHERE content <> ''""".replace("{STRIP}", STRIP),
)
def chunk_sections(spark, sf_dir):
    """A chunk for each section of Markdown, with its heading."""
    return chunking.chunk(docs(spark, sf_dir), "markdown_header").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return chunking.recursive(docs(spark, sf_dir), 128, 16)


@query("chunk_semantic")
def chunk_semantic(spark, sf_dir):
    return chunking.semantic(docs(spark, sf_dir))


_FINGER = f"sha256(array_to_string({SPLIT}, ' '))"


@query("exact_dedup", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_FINGER}")
def exact_dedup(spark, sf_dir):
    return dedup.exact(docs(spark, sf_dir)).select("doc_id")


@query(
    "dedup_across_runs",
    f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_FINGER} ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, doc_id) AS rank FROM documents) WHERE rank = 1",
)
def dedup_across_runs(spark, sf_dir):
    """Three runs over the documents, English ones first, then French ones, then all others: what a registry of fingerprints lets through."""
    own, registry = docs(spark, sf_dir), Registry(spark, new_path(spark, "registry"))
    runs = (F.col("lang") == "en", F.col("lang") == "fr", F.coalesce(~F.col("lang").isin("en", "fr"), F.lit(True)))
    return reduce(DataFrame.unionByName, [registry.admit(own.where(r).select("doc_id", "text")).select("doc_id") for r in runs])


@query("dup_groups", f"SELECT {_FINGER} AS fingerprint, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return dedup.groups(docs(spark, sf_dir)).where("copies > 1")


@query("fuzzy_dedup")
def fuzzy_dedup(spark, sf_dir):
    return dedup.alike_pairs(docs(spark, sf_dir))


_SQLP = dict(P.PERSONAL)


@query("pii_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))::BIGINT AS {k.lower()}" for k, p in _SQLP.items()) + " FROM documents")
def pii_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[c.alias(k.lower()) for k, c in P.counts("text").items()])


def _redacted() -> str:
    out = "coalesce(text, '')"
    for k, p in _SQLP.items():
        out = f"regexp_replace({out}, '{p}', '[{k}]', 'g')"
    return out


@query("pii_redact", f"SELECT doc_id, md5({_redacted()}) AS redacted_md5 FROM documents")
def pii_redact(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(P.redact("text")).alias("redacted_md5"))


@query("pii_block_flag", "SELECT doc_id, " + " OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for p in _SQLP.values()) + " AS blocked FROM documents")
def pii_block_flag(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", (F.size(P.found("text")) > 0).alias("blocked"))


@query("pii_spans")
def pii_spans(spark, sf_dir):
    return P.spans(docs(spark, sf_dir)).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")


def _any(patterns: list[str]) -> str:
    return f"regexp_matches(lower(coalesce(text, '')), '{'|'.join(patterns)}')"


@query("toxicity_flag", f"SELECT doc_id, {_any(P.TOXIC)}::DOUBLE AS toxicity FROM documents")
def toxicity_flag(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", P.moderation("text").toxicity.alias("toxicity"))


@query("injection_flag", f"SELECT conv_id, turn, {_any(P.INJECTION)} AS injection, {_any(P.JAILBREAK)} AS jailbreak FROM conversations")
def injection_flag(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.any_of("text", P.INJECTION).alias("injection"), P.any_of("text", P.JAILBREAK).alias("jailbreak"))


@query("moderate_summary", f"SELECT source, count(*) AS n, count_if({_any(P.TOXIC)}) AS toxic, count_if({_any(P.INJECTION)}) AS injection FROM documents GROUP BY source")
def moderate_summary(spark, sf_dir):
    flags = F.col("flags")
    return docs(spark, sf_dir).select("source", P.moderation("text").flags.alias("flags")).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.array_contains(flags, "toxicity")).alias("toxic"), F.count_if(F.array_contains(flags, "prompt_injection")).alias("injection"))


@query(
    "answer_filters",
    f"SELECT conv_id, turn, {_any(P.FILTER_TERMS)} AS toxicity, {_any(P.FILTER_TRIGGERS)} AS prompt_injection, " + " OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for k, p in _SQLP.items() if k != "IP_ADDRESS") + " AS pii FROM conversations WHERE role = 'assistant'",
)
def answer_filters(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    pii = F.size(P.found("text", [k for k in P.PERSONAL if k != "IP_ADDRESS"])) > 0
    return own.select("conv_id", "turn", P.any_of("text", P.FILTER_TERMS).alias("toxicity"), P.any_of("text", P.FILTER_TRIGGERS).alias("prompt_injection"), pii.alias("pii"))


_X = r"regexp_extract_all(coalesce(text, ''), '[^\s\x0b]+|[\s\x0b]+')"


@query(
    "truncate_context",
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {_X} AS x FROM documents) SELECT doc_id, md5(CASE WHEN len(x) <= 40 THEN t ELSE array_to_string(x[1:40], '') END) AS end_md5,
    md5(CASE WHEN len(x) <= 40 THEN t ELSE array_to_string(x[1:16], '') || array_to_string(x[len(x) - 23:], '') END) AS middle_md5, md5(CASE WHEN len(x) <= 40 THEN t ELSE array_to_string(x[len(x) - 39:], '') END) AS window_md5 FROM t""",
)
def truncate_context(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[F.md5(context.truncate("text", 40, how)).alias(f"{n}_md5") for n, how in (("end", "truncate_end"), ("middle", "truncate_middle"), ("window", "sliding_window"))])


@query(
    "compress_context",
    f"SELECT doc_id, md5(array_to_string(w[1:greatest(floor(len(w) * 0.5), 1)::BIGINT], ' ')) AS compressed_md5 FROM (SELECT doc_id, {SPLIT} AS w FROM documents)",
)
def compress_context(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(context.compress("text", 0.5)).alias("compressed_md5"))


@query("auto_title", r"SELECT conv_id, CASE WHEN length(t) <= 50 THEN t ELSE regexp_replace(t[1:50], ' [^ ]*$', '') || '...' END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def auto_title(spark, sf_dir):
    return records.auto_title(table(spark, sf_dir, "conversations"))


@query("history_window", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 AND role IN ('user', 'assistant')")
def history_window(spark, sf_dir):
    return records.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query(
    "conversation_stats",
    f"SELECT conv_id, count(*) AS n, count_if(role = 'user') AS n_user, count_if(role = 'assistant') AS n_assistant, count_if(role = 'system') AS n_system, sum(len({WORDS}))::BIGINT AS n_tokens FROM conversations GROUP BY conv_id",
)
def conversation_stats(spark, sf_dir):
    of = lambda r: F.count_if(F.col("role") == r)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), of("user").alias("n_user"), of("assistant").alias("n_assistant"), of("system").alias("n_system"), F.sum(F.size(T.words("text"))).alias("n_tokens"))


@query("export_markdown", "SELECT conv_id, string_agg('**' || upper(role[1]) || role[2:] || '**: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def export_markdown(spark, sf_dir):
    return records.export_markdown(table(spark, sf_dir, "conversations"))


@query("document_language")
def document_language(spark, sf_dir):
    """The language of each document (null under 50 characters), and with a fallback; the model is fitted on language.SAMPLE documents at most."""
    own = docs(spark, sf_dir).select("doc_id", "text", "lang")
    found = language.with_languages(own.select("doc_id", "text"), language.fit(own))
    detected, fallback = (f(F.col("text"), F.col("languages")).alias(n) for f, n in ((language.language, "language"), (language.language_or, "language_or_en")))
    return found.select("doc_id", detected, fallback, F.round(F.get("languages", F.lit(0))["prob"], 6).alias("prob"))


@query("query_language")
def query_language(spark, sf_dir):
    """The language of each benchmark item, as of a query."""
    found = language.with_languages(table(spark, sf_dir, "benchmark").select("item_id", "text"), language.fit(docs(spark, sf_dir)))
    return found.select("item_id", language.query_language(F.col("text"), F.col("languages")).alias("language"))
