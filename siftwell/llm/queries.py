"""The numbered queries: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import audio, bpe, decontaminate, language, line_dedup, minhash, quality, spelling, substring_dedup, token_counts, toxicity, vector_codes, warc
from siftwell.llm._labels import held_out
from siftwell.llm._store import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Digests of the ids of each text and of what they decode to."""
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    return bpe.encode(docs, codec, keep=["doc_id"], decoded="decoded").select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document before and after edits that mask personal data, counted by its segment tree."""
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    counted = token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), codec).withColumnRenamed("n_tokens", "n_before")
    return token_counts.recount(counted, codec, token_counts.masks).select("doc_id", F.col("n_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "n_encoded")


@query("op8_telephony")
def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resampled PCM is a column of the result, so it is stored where that is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    stored = written(audio.store(docs, keep=["doc_id", "n_bytes"]), "media")
    return audio.read(stored, pcm=True).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "pcm",
    )


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return quality.score(docs, machine, keep=["doc_id"]).select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(
    "op9_line_windows",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
    ), runs AS (
      SELECT doc_id, pos, line, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3 FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
    ), ranked AS (
      SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS rn
      FROM runs WHERE l3 IS NOT NULL AND trim(line || l2 || l3, ' ') <> ''
    ), gone AS (
      SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (VALUES (0), (1), (2)) t(d) WHERE rn > 1
    )
    SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
    """,
)
def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_GRAMS = r"""
    SELECT {id} AS id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM (SELECT {id}, regexp_extract_all(lower(text), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table})
"""


@query(
    "op10_contained_items",
    f"""
    WITH d AS (SELECT DISTINCT id, g FROM ({_GRAMS.format(id="doc_id", table="documents")})),
         i AS (SELECT DISTINCT id, g FROM ({_GRAMS.format(id="item_id", table="benchmark")})),
         n AS (SELECT id, count(*) AS n FROM i GROUP BY id),
         c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM d JOIN i ON d.g = i.g GROUP BY d.id, i.id)
    SELECT doc_id, item_id, shared, n AS n_shingles, shared / n AS containment FROM c JOIN n ON c.item_id = n.id WHERE shared >= ceil(0.8 * n - 1e-9)
    """,
)
def op10_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_dart_minhash")
def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op5_recompression",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
    h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM s),
    r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM h),
    gone AS (SELECT DISTINCT doc_id, i + d AS pos FROM r, (SELECT unnest(range(35)) AS d) WHERE n > 1),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
    kept AS (SELECT words.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS t
             FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
    SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
    """,
)
def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op6_warc")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    segments = warc.write(pages)
    places = warc.search(warc.build_index(segments), pages)
    return warc.read_places(segments, places, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_NEAREST = """
    SELECT vec_id, p, x, e, d FROM (
      SELECT v.vec_id, v.p, v.x, c.e, list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
             row_number() OVER (PARTITION BY v.vec_id, v.p ORDER BY list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.e) AS rank
      FROM v JOIN {books} c ON v.p = c.p) WHERE rank = 1
"""
_MOVED = """
    SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM {books} c LEFT JOIN (
      SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
        SELECT p, e, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM {near}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM v) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e) m
    ON c.p = m.p AND c.e = m.e
"""


@query(
    "op11_vector_codes",
    f"""
    WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS (SELECT vec_id, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
    c0 AS (SELECT p, rank - 1 AS e, x AS c FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
    n1 AS ({_NEAREST.format(books="c0")}), c1 AS ({_MOVED.format(books="c0", near="n1")}),
    n2 AS ({_NEAREST.format(books="c1")}), c2 AS ({_MOVED.format(books="c1", near="n2")}),
    n3 AS ({_NEAREST.format(books="c2")}),
    codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n3 GROUP BY vec_id),
    books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM codes JOIN kept USING (vec_id), books
    """,
)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    codes = vector_codes.with_label_error(written(codes, "final_codes"))
    digest = F.lit(books.digest if books else None).cast("string")
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


@query(
    "op12_spelling_variants",
    r"""
    WITH RECURSIVE step AS (SELECT list(t ORDER BY i) AS t FROM (
      SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) AS t FROM range(256) r(i))),
    runs AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents),
    hashed AS (SELECT run, h, count(*) AS n FROM (
      SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
                                  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
      FROM (SELECT * FROM runs WHERE length(run) >= 7), step) GROUP BY ALL),
    words AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    c AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cut AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM c, unnest(range(1, length(word) + 1)) u(i)),
    pairs AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
              UNION SELECT word, rest FROM cut JOIN (SELECT word AS rest FROM c) USING (rest) UNION SELECT rest, word FROM cut JOIN (SELECT word AS rest FROM c) USING (rest)),
    ranked AS (SELECT a, b, c.n AS m, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY c.n DESC, encode(b)) AS rank FROM pairs JOIN c ON c.word = b),
    f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN b END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
          FROM c LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) ON a = word),
    way AS (SELECT word, word AS root FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, way.root FROM f JOIN way ON f.word = way.word JOIN f g ON g.word = way.root WHERE g.form IS NULL
    """,
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are runs as they stand, but of one in 31 (by a hash of document and run) a code point is left out; a null id is written as nothing."""
    runs = spelling.runs(table(spark, sf_dir, "documents"), ["doc_id"])
    hashed = runs.select("run", F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return spelling.variants(written(spelling.count(words), "words")).select("word", "n", "n_near", "form", "form_n", "root")


@query("op13_language")
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out(1, 3)))
    return language.predict(docs, model, keep=["doc_id"]).select("doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score")
