"""Metadata, caches, logs, stores and chunk records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import privacy as P
from siftwell.functions import text as T
from siftwell.functions import vectors as V
from siftwell.operators import caching, context, evaluation, monitoring, records, sketches, vectors
from siftwell.plans.catalogue import query, table
from siftwell.plans.text_queries import SPLIT, STRIP
from siftwell.sources import files, typed
from siftwell.store import new_path

DAY = "2024-01-31 00:00:00"


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


@query("clean_custom", rf"""SELECT doc_id, md5({_strip(r"replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://[^\s\x0b]+|www\.[^\s\x0b]+', '', 'g'), '[0-9]+', '', 'g'), 'the', 'THE')")}) AS clean_md5 FROM documents""")
def clean_custom(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean("text", ["urls"], deletions=("[0-9]+",), replacements={"the": "THE"})).alias("clean_md5"))


@query("clean_special", rf"""SELECT doc_id, md5({_strip(r"regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\s\x0b]', '', 'g')")}) AS clean_md5 FROM documents""")
def clean_special(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean("text", ["special"])).alias("clean_md5"))


@query("unicode_nfc", "SELECT doc_id, md5(nfc_normalize(coalesce(text, ''))) AS nfc_md5 FROM documents")
def unicode_nfc(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalised("text")).alias("nfc_md5"))


@query("unicode_forms")
def unicode_forms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[F.md5(T.normalised("text", f)).alias(f.lower()) for f in ("NFD", "NFKC", "NFKD")])


@query("embedding_text", f"SELECT doc_id, md5(array_to_string(w, ' ')) AS whole_md5, md5(array_to_string(w[1:24], ' ')) AS split_md5, md5(array_to_string(w[greatest(len(w) - 23, 1):], ' ')) AS tail_md5 FROM (SELECT doc_id, {SPLIT} AS w FROM documents)")
def embedding_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.embedding_text("text")).alias("whole_md5"), F.md5(T.embedding_text("text", 24, "split")).alias("split_md5"), F.md5(T.embedding_text("text", 24)).alias("tail_md5"))


def _with_metadata(spark, sf_dir) -> DataFrame:
    """documents with a map of metadata as files have it, by their id: several author keys, some of them blank, and times as text."""
    i = F.col("doc_id")
    when = lambda rest, value: F.when(i % 5 == rest, value)
    pairs = {
        "author": F.when(i % 5 == 0, F.concat(F.lit("  "), "source", F.lit(" "))).when(i % 5 == 1, F.lit("  ")), "Author": when(1, F.col("lang")), "creator": when(2, F.lit("")), "dc:creator": when(2, F.concat("lang", F.lit("!"))),
        "created_time": F.when(i % 7 == 0, F.lit("no time")).otherwise((i * 1000.25).cast("string")), "source": F.when(i % 3 == 0, F.concat(F.lit("/data\\in/"), "source", F.lit(".md"))), "file_name": F.when(i % 3 == 1, F.lit("")),
        "source_path": F.when(i % 3 == 1, F.concat(F.lit("in/"), "lang")),
    }
    return docs(spark, sf_dir).withColumn("metadata", F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]))


@query(
    "document_author",
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN lang || '!' END AS author, CASE WHEN doc_id % 7 <> 0 THEN make_timestamp((doc_id * 1000250000)::BIGINT) END AS created_at, CASE doc_id % 3 WHEN 0 THEN source || '.md' WHEN 1 THEN lang ELSE doc_id::VARCHAR END AS name, CASE doc_id % 3 WHEN 0 THEN '/data\\in/' || source || '.md' WHEN 1 THEN 'in/' || lang ELSE doc_id::VARCHAR END AS full_name FROM documents",
)
def document_author(spark, sf_dir):
    m = F.col("metadata")
    return _with_metadata(spark, sf_dir).select(
        "doc_id", T.author(m).alias("author"), T.epoch_time(m["created_time"]).cast("timestamp_ntz").alias("created_at"), T.source_name(m, F.col("doc_id")).alias("name"), T.source_name(m, F.col("doc_id"), "full").alias("full_name")
    )


@query(
    "document_metadata_full",
    rf"""SELECT doc_id, 'default' AS tenant, 'general' AS domain, NULL::VARCHAR AS subdomain, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN lang || '!' END AS author, doc_id || '.md' AS source, source || '/' || doc_id || '.md' AS source_path, 'md' AS source_type, 'text/markdown' AS mime_type,
    CASE WHEN doc_id % 7 <> 0 THEN make_timestamp((doc_id * 1000250000)::BIGINT) END AS created_at, NULL::TIMESTAMP AS modified_at, TIMESTAMP '{DAY}' AS ingested_at, CASE WHEN length(coalesce(text, '')) >= 50 THEN lang END AS language, len({SPLIT})::BIGINT AS word_count, length(coalesce(text, ''))::BIGINT AS char_count,
    regexp_matches(coalesce(text, ''), '\|.*\|.*\|') AS has_tables, regexp_matches(coalesce(text, ''), '!\[.*?\]\(.*?\)') AS has_images, contains(coalesce(text, ''), '```') AS has_code, NULL::INT AS page_count, '' AS tags, NULL::VARCHAR AS category, 'internal' AS confidentiality, NULL::VARCHAR AS parser_engine, false AS ocr_applied,
    NULL::DOUBLE AS parsing_quality, '' AS parsing_warnings, 'draft' AS status, '1.0' AS version FROM documents""",
)
def document_metadata_full(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    kind, m = T.file_type(path), F.col("metadata")
    none = lambda t: F.lit(None).cast(t)
    fields = {
        "tenant": F.lit("default"), "domain": F.lit("general"), "subdomain": none("string"), "author": T.author(m), "source": F.regexp_extract(path, r"([^/\\]*)$", 1), "source_path": path, "source_type": kind, "mime_type": T.mime_type(kind),
        "created_at": T.epoch_time(m["created_time"]).cast("timestamp_ntz"), "modified_at": T.epoch_time(m["modified_time"]).cast("timestamp_ntz"), "ingested_at": F.lit(DAY).cast("timestamp_ntz"), "language": F.when(F.char_length("text") >= 50, F.col("lang")),
        "word_count": F.size(T.split_words("text")).cast("long"), "char_count": F.char_length(F.coalesce("text", F.lit(""))).cast("long"), "has_tables": T.has_tables("text"), "has_images": T.has_images("text"), "has_code": T.has_code("text"),
        "page_count": m["page_count"].cast("int"), "tags": F.lit(""), "category": none("string"), "confidentiality": F.lit("internal"), "parser_engine": m["parser_engine"], "ocr_applied": F.coalesce(m["ocr_applied"].cast("boolean"), F.lit(False)),
        "parsing_quality": m["parsing_quality"].cast("double"), "parsing_warnings": F.coalesce(m["parsing_warnings"], F.lit("")), "status": F.lit("draft"), "version": F.lit("1.0"),
    }
    return _with_metadata(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in fields.items()])


@query(
    "chunk_metadata",
    f"""SELECT doc_id, i::INT AS chunk_index, CASE WHEN i % 2 = 0 THEN 'own' ELSE lang END AS language, source, 'chunk_' || i || '_' || md5(array_to_string(w[i * 100 + 1:i * 100 + 100], ' '))[1:8] AS chunk_id
    FROM (SELECT *, unnest(range(0, (len(w) + 99) // 100)) AS i FROM (SELECT doc_id, lang, source, {SPLIT} AS w FROM documents))""",
)
def chunk_metadata(spark, sf_dir):
    """Chunks of 100 words with names of their own, the language that some have, and the rest from their documents."""
    from siftwell.operators import chunking

    own = chunking.fixed(docs(spark, sf_dir), 100, 0)
    own = own.select("doc_id", "chunk_index", F.when(F.col("chunk_index") % 2 == 0, "own").alias("language"), T.chunk_name(F.lit(None).cast("string"), F.col("chunk_index"), F.col("content")).alias("chunk_id"))
    return records.propagated(own, docs(spark, sf_dir).withColumnRenamed("lang", "language"), ["language", "source"])


_PARSER = "CASE WHEN doc_id % 6 IN (1, 2) THEN 'html' WHEN doc_id % 6 = 0 THEN 'markdown' WHEN doc_id % 6 = 3 THEN 'csv' ELSE 'text' END"


@query("route_by_type", f"SELECT doc_id, {_PARSER} AS parser, md5(CASE WHEN {_PARSER} = 'html' THEN 'x ' || doc_id || ' y' ELSE '<p>x</p> ' || doc_id || '<b>y' END) AS text_md5 FROM documents")
def route_by_type(spark, sf_dir):
    """Files of six types, by their documents' ids, with the text that their parser gives."""
    ext = F.element_at(F.array(*map(F.lit, ("md", "HTML", "htm", "csv", "pdf", "xyz"))), (F.col("doc_id") % 6 + 1).cast("int"))
    own = docs(spark, sf_dir).select("doc_id", T.file_type(F.concat(F.lit("a/f."), ext)).alias("file_type"), F.concat(F.lit("<p>x</p> "), F.col("doc_id").cast("string"), F.lit("<b>y")).cast("binary").alias("content"))
    return files.parsed(own).select("doc_id", "parser", F.md5("text").alias("text_md5"))


_ORDER = "o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, md5(o_orderpriority) AS priority_md5"


@query("typed_records", " UNION ALL ".join(f"SELECT '{k}' AS kind, {_ORDER} FROM orders" for k in ("csv", "json", "xml")))
def typed_records(spark, sf_dir):
    """Orders as CSV, JSON and XML files, read back as records whose types are inferred."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    out = []
    for kind, more in (("csv", {"header": "true"}), ("json", {}), ("xml", {"rowTag": "row"})):
        at = new_path(spark, f"orders-{kind}")
        own.write.format(kind).options(**more).save(at)
        good, _ = typed.records(spark, at, kind)
        out.append(good.select(F.lit(kind).alias("kind"), "o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), F.md5("o_orderpriority").alias("priority_md5")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("json_documents", "SELECT doc_id, lang, n_chars, md5(text) AS text_md5, length(text)::BIGINT AS n FROM documents")
def json_documents(spark, sf_dir):
    """Whole documents as JSON lines, read back as typed records."""
    at = new_path(spark, "documents-json")
    docs(spark, sf_dir).select("doc_id", "text", "lang", "n_chars").write.json(at)
    good, _ = typed.records(spark, at, "json")
    return good.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("n"))


@query("page_merge", "SELECT conv_id, md5(string_agg(chr(10) || chr(10) || '--- Page ' || turn || ' ---' || chr(10) || chr(10) || coalesce(text, '') || CASE WHEN role = 'user' THEN chr(10) || chr(10) || '[TABLE]' || chr(10) || 'a | b' || chr(10) ELSE '' END, '' ORDER BY turn)) AS content_md5 FROM conversations GROUP BY conv_id")
def page_merge(spark, sf_dir):
    """Turns stand for pages; those of users have a table."""
    own = table(spark, sf_dir, "conversations").withColumn("tables", F.when(F.col("role") == "user", F.array(files.plain_table(F.array(F.array(F.lit("a"), F.lit("b")))))))
    return files.merged_pages(own, "conv_id", "turn", tables="tables").select("conv_id", F.md5("content").alias("content_md5"))


_CELLS = "SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation"


@query(
    "table_strategies",
    f"""SELECT n_regionkey, '| ' || string_agg(n_nationkey || ' | ' || n_name || CASE WHEN i = 1 THEN ' |' || chr(10) || '| --- | ---' ELSE '' END, ' |' || chr(10) || '| ' ORDER BY i) || ' |' AS markdown,
    string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY i) AS separate, '[' || string_agg('["' || n_nationkey || '","' || n_name || '"]', ',' ORDER BY i) || ']' AS preserve FROM ({_CELLS}) WHERE i <= 3 GROUP BY n_regionkey""",
)
def table_strategies(spark, sf_dir):
    """A table of each region's nations, of three rows and two columns at most."""
    row = F.array(F.col("n_nationkey").cast("string"), "n_name", F.lit("a third column"))
    own = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x.r).alias("rows"))
    return own.select("n_regionkey", *[files.table_as(F.col("rows"), s, 3, 2).content.alias(s) for s in ("markdown", "separate", "preserve")])


@query("uuid5_ids", "SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (position(h[17] IN '0123456789abcdef') - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS id FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)")
def uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.identifier(F.col("url")).alias("id"))


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label, round(CASE WHEN vec_id % 5 = 0 THEN 2 * embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings")
def vector_upsert(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    new = own.where("vec_id % 5 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.transform("embedding", lambda x: 2 * x).alias("embedding"))
    return records.upsert(own, records.embedded(new), "vec_id").select("vec_id", "label", F.round(F.col("embedding")[0], 6).alias("first"))


@query("list_chunks", "SELECT vec_id, label FROM embeddings")
def list_chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label")


@query("document_page", "SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY doc_id LIMIT 100 OFFSET 50")
def document_page(spark, sf_dir):
    """The second page of a store's document ids; its size is what is asked for."""
    return docs(spark, sf_dir).select("doc_id").distinct().orderBy("doc_id").offset(50).limit(100)


@query("float16_vectors")
def float16_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.float16(F.col("embedding")).alias("embedding"), V.key(F.col("embedding")).alias("key"))


@query("pca_vectors")
def pca_vectors(spark, sf_dir):
    return V.reduced(table(spark, sf_dir, "embeddings"), 8).select("vec_id", "reduced")


@query("embed_once")
def embed_once(spark, sf_dir):
    """Embeddings of whole texts, made once for each distinct text."""

    def make(texts: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def run(words):
            return words.map(lambda w: vectors.hashed_embedding(list(w)))

        return texts.select("text_key", run(T.words("text")).alias("embedding"))

    return caching.once(docs(spark, sf_dir).select("doc_id", "text"), T.embedding_text("text"), make).select("doc_id", "embedding")


@query("export_json", """SELECT conv_id, md5('[' || string_agg('{"turn":' || turn || ',"role":"' || role || '","text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}', ',' ORDER BY turn, role, text) || ']') AS json_md5 FROM conversations GROUP BY conv_id""")
def export_json(spark, sf_dir):
    return records.export_json(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("json").alias("json_md5"))


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("events_by_intent", "SELECT event_type AS intent, count(*) AS n FROM events WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY event_type")
def events_by_intent(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type <> ''").groupBy(F.col("event_type").alias("intent")).agg(F.count("*").alias("n"))


_RUNS = "SELECT user_id, count(*) AS documents, count(*) * 3 AS chunks, sum(value::DECIMAL(18, 2))::DOUBLE AS duration, count_if(event_type = 'error') AS errors, max(ts) AS ts FROM events GROUP BY user_id"


@query("ingestion_summary", f"SELECT count(*) AS runs, sum(documents)::BIGINT AS documents, sum(chunks)::BIGINT AS chunks, round(avg(duration), 6) AS avg_duration, max(ts) AS last_run, sum(errors)::BIGINT AS errors FROM ({_RUNS})")
def ingestion_summary(spark, sf_dir):
    """A user's events stand for a run."""
    runs = _events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("documents"), (F.count("*") * 3).alias("chunks"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("duration"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("ts")
    )
    return monitoring.ingestion_summary(runs)


@query("component_errors", "SELECT user_id, count(*) AS calls, count_if(event_type = 'error') AS errors, round(avg(value), 6) AS mean, arg_max(props, event_id) FILTER (WHERE event_type = 'error') AS last_error FROM events GROUP BY user_id")
def component_errors(spark, sf_dir):
    return monitoring.by_component(_events(spark, sf_dir), "user_id", F.col("event_type") == "error", F.col("props"), F.col("event_id"))


@query("average_latency", "SELECT user_id, count(*) AS n, round_even(avg(nullif(floor(value), 0)), 2) AS mean FROM events GROUP BY user_id")
def average_latency(spark, sf_dir):
    """Null and zero latencies don't count."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.bround(F.avg(F.nullif(F.floor("value").cast("double"), F.lit(0.0))), 2).alias("mean"))


@query(
    "ingestion_counters",
    f"""WITH f AS (SELECT min(doc_id) AS doc_id, count(*) AS n, any_value(len(w)) AS words FROM (SELECT doc_id, {SPLIT} AS w FROM documents) GROUP BY sha256(array_to_string(w, ' ')))
    SELECT sum(n)::BIGINT AS documents_loaded, (sum(n) - count(*))::BIGINT AS documents_deduplicated, count(*) AS documents_parsed, sum(greatest(ceil((words - 50) / 462.0), 0) + CASE WHEN words > 0 AND words <= 50 THEN 1 ELSE 0 END)::BIGINT AS chunks_created FROM f""",
)
def ingestion_counters(spark, sf_dir):
    """What a run over documents loads, drops as copies, parses and cuts into chunks of 512 words with an overlap of 50."""
    from siftwell.operators import chunking, dedup

    own = docs(spark, sf_dir).select(dedup.fingerprint().alias("f"), F.size(T.split_words("text")).alias("words"))
    per = own.groupBy("f").agg(F.count("*").alias("n"), F.any_value("words").alias("words"))
    chunks = F.when(F.col("words") > 0, F.size(chunking.windows(F.col("words"), 512, 50))).otherwise(0)
    return per.agg(F.sum("n").alias("documents_loaded"), (F.sum("n") - F.count("*")).alias("documents_deduplicated"), F.count("*").alias("documents_parsed"), F.sum(chunks).cast("long").alias("chunks_created"))


@query(
    "metric_rows",
    "SELECT metric, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 'query_count' AS metric, 1.0::DOUBLE AS v FROM events UNION ALL SELECT 'query_latency_ms', value FROM events UNION ALL SELECT 'component_error', 1.0 FROM events WHERE event_type = 'error') GROUP BY metric",
)
def metric_rows(spark, sf_dir):
    """Each event records a count and a latency, a failed one an error as well."""
    yes = F.lit(True)
    made = monitoring.metric_rows(_events(spark, sf_dir).select("value", "event_type"), {"query_count": (F.lit(1), yes), "query_latency_ms": (F.col("value"), yes), "component_error": (F.lit(1), F.col("event_type") == "error")})
    return made.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("metric_value"), 2).alias("total"))


@query("component_costs", "SELECT event_type, round(sum(value * 0.002), 4) AS cost FROM events GROUP BY event_type")
def component_costs(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(F.col("value") * 0.002), 4).alias("cost"))


_SHARE = "count_if(event_type = 'error') / count(*)"
_STATUS = "CASE WHEN {c} >= 0.25 THEN 'unhealthy' WHEN {c} >= 0.2 THEN 'degraded' ELSE 'healthy' END"


@query("component_health", f"SELECT user_id, {_STATUS.format(c='s')} AS status, {_STATUS.format(c='max(s) OVER ()')} AS overall FROM (SELECT user_id, {_SHARE} AS s FROM events GROUP BY user_id)")
def component_health(spark, sf_dir):
    own = _events(spark, sf_dir).groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("share"))
    return monitoring.health(own, F.col("share"), 0.2, 0.25).select("user_id", "status", "overall")


_DAILY = "SELECT date_trunc('day', ts) AS day, max(value) AS peak, avg(value) AS mean, sum(value * 0.002) AS cost FROM events GROUP BY 1"


@query(
    "alerts_daily",
    f"SELECT day, 'peak' AS name, 'critical' AS severity, round(peak, 6) AS value, 300.0::DOUBLE AS threshold FROM ({_DAILY}) WHERE peak > 300 UNION ALL SELECT day, 'mean', 'warning', round(mean, 6), 49.0 FROM ({_DAILY}) WHERE mean < 49 UNION ALL SELECT day, 'cost', 'warning', round(cost, 6), 34.0 FROM ({_DAILY}) WHERE cost > 34",
)
def alerts_daily(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")
    per = _events(spark, sf_dir).groupBy(day).agg(F.max("value").alias("peak"), F.avg("value").alias("mean"), F.sum(F.col("value") * 0.002).alias("cost"))
    rules = [("peak", "over", "critical", 300.0), ("mean", "under", "warning", 49.0), ("cost", "over", "warning", 34.0)]
    return monitoring.alerts(per, rules, ["day"]).withColumn("value", F.round("value", 6))


_SLICED = "SELECT event_type, date_trunc('hour', ts) AS bucket, sign(value)::BIGINT * ((v >> k) << k) AS slice FROM (SELECT *, greatest(length(CASE WHEN v = 0 THEN '0' ELSE ltrim(bin(v), '0') END) - 7, 0)::INTEGER AS k FROM (SELECT *, floor(abs(value) * 1000)::BIGINT AS v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL))"
_WINDOWS = f"SELECT event_type, bucket + h * INTERVAL 1 HOUR AS until, slice FROM ({_SLICED}), (SELECT unnest(range(1, 25)) AS h)"
_RANKED = f"SELECT event_type, until, slice, row_number() OVER (PARTITION BY event_type, until ORDER BY slice) - 1 AS r, count(*) OVER (PARTITION BY event_type, until) AS n FROM ({_WINDOWS})"
_ROLLED = f"SELECT event_type, until::TIMESTAMP AS until, max(n)::BIGINT AS n, " + ", ".join(f"max(CASE WHEN r = round_even({p / 100} * (n - 1), 0) THEN slice END) / 1000.0::DOUBLE AS p{p}" for p in (50, 95, 99)) + f" FROM ({_RANKED}) GROUP BY event_type, until"


@query("rolling_percentiles", _ROLLED)
def rolling_percentiles(spark, sf_dir):
    """Percentiles of 24 hours to each full hour, merged from sketches of hours."""
    own = sketches.windows(sketches.sketched(_events(spark, sf_dir), ["event_type"]), ["event_type"])
    return sketches.quantiles(own, ["event_type", "until"], [50, 95, 99]).withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("rolling_percentile_alerts", f"SELECT * FROM ({_ROLLED}) WHERE p95 > 160 OR p50 > 36")
def rolling_percentile_alerts(spark, sf_dir):
    return sketches.breaches(rolling_percentiles(spark, sf_dir), {"p95": 160.0, "p50": 36.0})


@query("audit_log", f"SELECT conv_id, turn, sha256(q) AS query_hash, NULL::VARCHAR AS query_text, length(q)::BIGINT AS query_length, length(r)::BIGINT AS response_length FROM (SELECT a.conv_id, a.turn, coalesce(q.text, '') AS q, coalesce(a.text, '') AS r, TIMESTAMP '{DAY}' - (a.conv_id % 60) * INTERVAL 1 DAY AS ts FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant') WHERE ts >= TIMESTAMP '{DAY}' - INTERVAL 30 DAY")
def audit_log(spark, sf_dir):
    """Questions and answers without their texts; entries of 30 days are kept."""
    own = table(spark, sf_dir, "conversations")
    asked = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    now = F.lit(DAY).cast("timestamp_ntz")
    log = own.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).withColumn("ts", now - F.make_dt_interval((F.col("conv_id") % 60).cast("int")))
    return records.retained(records.audit_entries(log, F.col("question"), F.col("text")), now, 30).select("conv_id", "turn", "query_hash", "query_text", "query_length", "response_length")


@query("feedback_last", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def feedback_last(spark, sf_dir):
    """The last 500 entries are kept."""
    return _events(spark, sf_dir).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(500).select("event_id", "user_id", "value")


@query("stores_newest_first", "SELECT user_id, max(ts) AS updated_at, row_number() OVER (ORDER BY max(ts) DESC, user_id)::INT AS place FROM events GROUP BY user_id QUALIFY place <= 20")
def stores_newest_first(spark, sf_dir):
    from siftwell.operators import lexical

    own = _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    return lexical.top(own.withColumn("_all", F.lit(1)), 20, "user_id", "updated_at", "_all").select("user_id", "updated_at", F.col("rank").alias("place"))


@query("message_bumps", "SELECT c_custkey, greatest(c_custkey % 9, coalesce(m, c_custkey % 9)) AS updated_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey % 11) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def message_bumps(spark, sf_dir):
    """Orders stand for messages of their customers' conversations."""
    own = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 9).alias("updated_at"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 11).alias("updated_at"))
    return records.bumped(own, new, "c_custkey")


@query("state_commit", "SELECT event_id AS path, CASE WHEN event_id % 4 = 0 THEN event_id + 10 ELSE event_id END AS mtime FROM events WHERE event_id % 2 = 0 OR event_id % 4 = 0 UNION ALL SELECT event_id, event_id + 10 FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0")
def state_commit(spark, sf_dir):
    """The state has even paths; a run over files with newer times stores those divisible by 4 and odd ones divisible by 3."""
    own = _events(spark, sf_dir).select(F.col("event_id").alias("path"), F.col("event_id").alias("mtime"))
    new = own.withColumn("mtime", F.col("mtime") + 10)
    pending = records.pending(new, own.where("path % 2 = 0"))
    return records.committed(own.where("path % 2 = 0"), pending, pending.where("path % 4 = 0 OR path % 2 = 1 AND path % 3 = 0"))


_EXT = ["pdf", "MD", "txt", "html", "csv", "json", "docx", "doc", "tar.gz", ""]
_MIMES = "CASE doc_id % 10 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'text/html' WHEN 4 THEN 'text/csv' WHEN 5 THEN 'application/json' WHEN 6 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 7 THEN 'application/msword' END"


@query("mime_types", f"SELECT doc_id, ['pdf', 'md', 'txt', 'html', 'csv', 'json', 'docx', 'doc', 'gz', 'unknown'][doc_id % 10 + 1] AS file_type, {_MIMES} AS mime_type FROM documents")
def mime_types(spark, sf_dir):
    """Paths of ten kinds, by their documents' ids; the last has no extension, and what has no known one has no media type."""
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 10 + 1).cast("int"))
    kind = T.file_type(F.concat(F.lit("in.d/f"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))))
    return docs(spark, sf_dir).select("doc_id", kind.alias("file_type"), T.mime_type(kind).alias("mime_type"))


@query("documents_by_status", "SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC)::INT AS place FROM documents WHERE lang = 'en' AND doc_id % 4 = 1 QUALIFY place <= 50")
def documents_by_status(spark, sf_dir):
    """The first page of a store's documents of one status, the newest first: the language stands for the store, the id for the status, the size for the time."""
    own = docs(spark, sf_dir).where("lang = 'en' AND doc_id % 4 = 1").orderBy(F.col("n_chars").desc(), F.col("doc_id").desc()).limit(50)
    from pyspark.sql import Window

    # A page of 50 rows, which limit has made one partition of.
    return own.select("doc_id", "source", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), F.col("doc_id").desc())).alias("place"))


@query("state_history", "SELECT user_id, event_id, value, r::INT AS back FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def state_history(spark, sf_dir):
    """The last five states of each key, the newest first."""
    from siftwell.operators import lexical

    return lexical.top(_events(spark, sf_dir).select("user_id", "event_id", "value"), 5, "event_id", "event_id", "user_id").withColumnRenamed("rank", "back")


_PII = {k: v for k, v in P.PERSONAL.items()}


@query("pii_policy", "SELECT doc_id, CASE WHEN n > 0 THEN 'block' ELSE 'pass' END AS action, n AS n_types FROM (SELECT doc_id, (" + " + ".join(f"regexp_matches(coalesce(text, ''), '{p}')::INT" for p in _PII.values()) + ")::INT AS n FROM documents)")
def pii_policy(spark, sf_dir):
    found = P.found("text")
    return docs(spark, sf_dir).select("doc_id", F.when(F.size(found) > 0, "block").otherwise("pass").alias("action"), F.size(found).alias("n_types"))


_KEY = rf"""md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(text, '')), {STRIP}, '', 'g'), '[^\p{{L}}\p{{N}}_\s\x0b]', '', 'g'), '[\s\x1c-\x1f\x{{85}}\p{{Z}}\x0b]+'),
    lambda x: x <> '' AND NOT list_contains([{", ".join(f"'{w}'" for w in T.KEY_WORDS)}], x)), ' '))"""
_FIRST = "SELECT conv_id, turn, rn > 1 AS hit, CASE WHEN rn > 1 THEN c END AS source_conv, CASE WHEN rn > 1 THEN t END AS source_turn FROM (SELECT conv_id, turn, row_number() OVER w AS rn, first_value(conv_id) OVER w AS c, first_value(turn) OVER w AS t FROM (SELECT conv_id, turn, {key} AS k FROM conversations WHERE role = 'user') WINDOW w AS (PARTITION BY k ORDER BY conv_id, turn))"


@query("cache_exact", _FIRST.format(key="md5(coalesce(text, ''))"))
def cache_exact(spark, sf_dir):
    return _looked_up(spark, sf_dir, F.md5(F.coalesce("text", F.lit(""))))


@query("cache_fuzzy", _FIRST.format(key=_KEY))
def cache_fuzzy(spark, sf_dir):
    return _looked_up(spark, sf_dir, T.cache_key("text"))


def _looked_up(spark, sf_dir, key) -> DataFrame:
    own = table(spark, sf_dir, "conversations").where("role = 'user'")
    return caching.lookups(own, key, ["conv_id", "turn"]).select("conv_id", "turn", "hit", F.col("source.conv_id").alias("source_conv"), F.col("source.turn").alias("source_turn"))


@query("cache_hit_rates", "SELECT turn, count_if(hit) AS hits, count_if(NOT hit) AS misses, round(count_if(hit) / count(*), 6) AS rate FROM (" + _FIRST.format(key=_KEY) + ") GROUP BY turn")
def cache_hit_rates(spark, sf_dir):
    return monitoring.hit_rates(cache_fuzzy(spark, sf_dir), "turn")


@query("cache_semantic", "SELECT query_id, vec_id, score FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS r FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id % 2 = 1) WHERE r = 1 AND score >= 0.4")
def cache_semantic(spark, sf_dir):
    """Odd vectors are cached; those divisible by 100 ask."""
    own = table(spark, sf_dir, "embeddings")
    return caching.semantic(own.where("vec_id % 100 = 0"), own.where("vec_id % 2 = 1"), 0.4)


@query("cache_kept", f"SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts > TIMESTAMP '{DAY}' - INTERVAL 10 DAY) WHERE r <= 50")
def cache_kept(spark, sf_dir):
    """A cache of 50 entries a type that live ten days."""
    own = caching.alive(_events(spark, sf_dir), F.lit(DAY).cast("timestamp_ntz"), 864_000)
    return caching.most_recent(own, 50, "event_type").select("event_type", "event_id")


_ANSWERS = rf"""SELECT a.conv_id, a.turn, coalesce(a.text, '') AS answer, list_distinct(regexp_extract_all(lower(coalesce(a.text, '')), '[\p{{L}}\p{{N}}_]+')) AS r,
    list_distinct(regexp_extract_all(lower(coalesce(q.text, '') || ' ' || coalesce(n.text, '')), '[\p{{L}}\p{{N}}_]+')) AS c, list_distinct(regexp_extract_all(lower(coalesce(n.text, '')), '[\p{{L}}\p{{N}}_]+')) AS t
    FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 LEFT JOIN conversations n ON a.conv_id = n.conv_id AND n.turn = a.turn + 1 WHERE a.role = 'assistant'"""


def _answers(spark, sf_dir) -> DataFrame:
    """Answers with the turns around them as context, and the turn that follows as the truth."""
    own = table(spark, sf_dir, "conversations")
    before = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    after = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    rows = own.where("role = 'assistant'").join(before, ["conv_id", "turn"]).join(after, ["conv_id", "turn"], "left")
    return rows.withColumn("context", F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("truth", F.lit(""))))


@query(
    "answer_context_measures",
    f"""SELECT conv_id, turn, round(CASE WHEN len(r) > 0 THEN len(list_intersect(r, c)) / len(r) ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN len(c) > 0 THEN len(list_intersect(c, r)) / len(c) ELSE 0 END, 6)::DOUBLE AS recall,
    round(CASE WHEN len(list_distinct(list_concat(r, t))) = 0 THEN 1 ELSE len(list_intersect(r, t)) / len(list_distinct(list_concat(r, t))) END, 6)::DOUBLE AS correctness FROM ({_ANSWERS})""",
)
def answer_context_measures(spark, sf_dir):
    m = evaluation.answer_measures(F.col("question"), F.col("text"), F.col("context"), F.col("truth"))
    return _answers(spark, sf_dir).select("conv_id", "turn", *[F.round(m[k], 6).alias(n) for k, n in (("context_precision", "precision"), ("context_recall", "recall"), ("answer_correctness", "correctness"))])


@query(
    "answer_validation",
    rf"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN NOT regexp_matches(answer, '\[\d+\]') THEN 'No citations found' END, CASE WHEN f < 0.4 THEN 'Low faithfulness: ' || printf('%.2f', round_even(f, 2)) END,
    CASE WHEN regexp_matches(lower(answer), '{"|".join(P.FILTER_TERMS)}') THEN 'Content filter triggered: toxicity' END], lambda x: x IS NOT NULL), '; ') AS issues
    FROM (SELECT *, (CASE WHEN len(r) > 0 THEN len(list_intersect(r, c)) / len(r) ELSE 0 END)::DOUBLE AS f FROM ({_ANSWERS}))""",
)
def answer_validation(spark, sf_dir):
    faithful = evaluation.answer_measures(F.col("question"), F.col("text"), F.col("context"), F.col("truth"))["faithfulness"]
    found = context.issues(F.coalesce("text", F.lit("")), "numbered", faithful, 0.4, {"toxicity": P.any_of("text", P.FILTER_TERMS)})
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(found, "; ").alias("issues"))


@query(
    "citation_forms",
    "SELECT doc_id, translate(doc_id::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS footnote, '[' || doc_id || '] [Source: ' || source || ', page ' || CASE WHEN doc_id % 4 = 0 THEN '?' ELSE (doc_id % 7)::VARCHAR END || ', section ' || lang || ', ?]' AS header FROM documents",
)
def citation_forms(spark, sf_dir):
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    page = F.when(i % 4 != 0, i % 7)
    return docs(spark, sf_dir).select("doc_id", context.citation(i, F.col("source"), page, "footnote").alias("footnote"), context.source_header(i, F.col("source"), page, F.col("lang"), none).alias("header"))


@query("truncate_summary", r"SELECT doc_id, md5(CASE WHEN len(x) <= 40 THEN t ELSE array_to_string(x[1:20], '') || array_to_string(x[len(x) - 19:], '') || chr(10) || '...[summary omitted due to length]...' || chr(10) END) AS summary_md5 FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\s\x0b]+|[\s\x0b]+') AS x FROM documents)")
def truncate_summary(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(context.truncate("text", 40, "summarize_overflow")).alias("summary_md5"))


