"""Column functions on text: tokens, sentences, cleaning steps, features, names. All but normalised are built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Stop words, lower case.
ENGLISH = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()
FRENCH = (
    "alors au aucuns aussi autre avant avec avoir bon car ce cela ces ceux chaque comme comment dans des du elle elles en encore est et eu "
    "fait faites fois font hors ici il ils je juste la le les leur ma maintenant mais mes mine moins mon mot meme ni notre nous ou par parce "
    "pas peut peu plupart pour pourquoi quand que quel quelle quelles quels qui sa sans ses seulement si son sont sous sur ta tandis te "
    "tellement tels tes ton tous tout trop tres tu voient vont votre vous vu"
).split()
#: Stop words of cache keys.
KEY_WORDS = "the is a an and or to of in for on how what".split()
#: Suffixes in the order in which they are tried.
SUFFIXES = ["ing", "ed", "ly", "es", "s", "ment", "tion", "ions", "ement"]


def _c(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def words(text: Column | str, lower: bool = True) -> Column:
    t = _c(text)
    return F.regexp_extract_all(F.lower(t) if lower else t, F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column | str) -> Column:
    """How many words there are, without an array of them."""
    return F.regexp_count(F.lower(_c(text)), F.lit(WORD))


def split_words(text: Column | str) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(_c(text), SPACE), lambda w: w != "")


def without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stop))


def stem(token: Column) -> Column:
    """token without the first suffix of SUFFIXES that leaves more than two characters."""
    out = token
    for s in reversed(SUFFIXES):
        out = F.when(token.endswith(s) & (F.length(token) > len(s) + 2), F.substring(token, F.lit(1), F.length(token) - len(s))).otherwise(out)
    return out


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(
        F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def sentences(text: Column | str) -> Column:
    """Pieces that end in . ! or ? before white space; the whole text if there is none."""
    t = _c(text)
    parts = F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).when(strip(t) == "", F.array().cast("array<string>")).otherwise(F.array(strip(t)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def single_spaced(text: Column | str) -> Column:
    """The words between white space, joined by one space; as split_words without an array."""
    return F.btrim(F.regexp_replace(_c(text), SPACE, " "), F.lit(" "))


def replace_all(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), patterns, text)


#: Patterns of the cleaning steps by name, in the order in which they are applied.
STEPS: dict[str, list[tuple[str, str]]] = {
    "urls": [(r"https?://\S+|www\.\S+", "")],
    "emails": [(r"(?U)\b[\w.-]+@[\w.-]+\.[a-zA-Z]{2,}\b", "")],
    "phones": [(r"(?U)\b\+?\d[\d\s()-]{7,}\d\b", "")],
    "punctuation": [(r"[^\p{L}\p{N}_\s]", "")],
    "special": [(r"[^\p{L}\p{N}\s]", "")],
    "control": [(r"[\p{C}&&[^\n\t]]", "")],
    "control_all": [(r"\p{C}", "")],
    "newlines": [(r"\n{3,}", "\n\n")],
    "whitespace": [(r"[\t\r\f\x0b]+", " "), (r" {2,}", " ")],
}


def clean(text: Column | str, steps: list[str], deletions: tuple[str, ...] = (), replacements: dict[str, str] | None = None, lower: bool = False) -> Column:
    """Cleaned and stripped text; null counts as empty.

    control keeps line ends and tabs; control_all deletes every character of category C, so newlines and tabs go
    before the steps for white space see them.
    """
    chosen = [p for name, own in STEPS.items() if name in steps for p in own]
    cut = next((i for i, p in enumerate(chosen) if p[0] not in {x[0] for s in ("urls", "emails", "phones") for x in STEPS[s]}), len(chosen))
    t = replace_all(_c(text), chosen[:cut] + [(d, "") for d in deletions])
    for old, new in (replacements or {}).items():
        t = F.replace(t, F.lit(old), F.lit(new))
    t = replace_all(t, chosen[cut:])
    return strip(F.lower(t) if lower else t)


def has_tables(text: Column | str) -> Column:
    return _c(text).rlike(r"\|.*\|.*\|")


def has_images(text: Column | str) -> Column:
    return _c(text).rlike(r"!\[.*?\]\(.*?\)")


def has_code(text: Column | str) -> Column:
    return F.instr(_c(text), "```") > 0


def title(text: Column | str, stem_name: Column) -> Column:
    """The first heading of level one; else a first line under 200 characters without a full stop; else stem_name."""
    t = _c(text)
    heading = F.regexp_extract(t, r"(?m)^#[ \t]+(\S.*)$", 1)
    line = strip(F.regexp_replace(F.element_at(F.split(strip(t), "\n"), 1), "^#+", ""))
    return F.when(heading != "", strip(heading)).when((line != "") & (F.char_length(line) < 200) & (F.instr(line, ".") == 0), line).otherwise(stem_name)


def truncate_words(text: Column | str, n: int, how: str = "end") -> Column:
    """At most n words: start and split keep the head, end the tail, middle half of each around an ellipsis."""
    w = split_words(text)
    joined = lambda x: F.array_join(x, " ")
    half = n // 2
    out = {
        "start": joined(F.slice(w, 1, n)),
        "split": joined(F.slice(w, 1, n)),
        "end": joined(F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), F.lit(n))),
        "middle": F.concat(joined(F.slice(w, 1, half)), F.lit(" ... "), joined(F.slice(w, F.greatest(F.size(w) - (half - 1), F.lit(1)), F.lit(half)))),
    }[how]
    return F.when(F.size(w) <= n, _c(text)).otherwise(out)


def cache_key(query: Column | str) -> Column:
    """md5 of the lower-cased words without signs and stop words."""
    t = F.regexp_replace(strip(F.lower(_c(query))), r"[^\p{L}\p{N}_\s]", "")
    return F.md5(F.array_join(without(split_words(t), KEY_WORDS), " "))


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r".\.([^.]+)$", 1))
    return F.when(ext == "", "unknown").when(ext.isin("md", "markdown"), "md").otherwise(ext)


#: Media types by extension.
MIME = {"pdf": "application/pdf", "md": "text/markdown", "txt": "text/plain", "html": "text/html", "csv": "text/csv", "json": "application/json",
        "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword"}


def mime_type(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), kind)


def stem_of(name: Column) -> Column:
    """A file name up to its last dot (a dot at its start counts as part of it)."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def normalised(text: Column | str, form: str = "NFC") -> Column:
    """A Unicode normal form (NFC, NFD, NFKC, NFKD); null counts as empty. Spark has no such function, so batches go through Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t))

    return run(_c(text))


def embedding_text(text: Column | str, most: int | None = None, how: str = "end") -> Column:
    """A text as it is embedded: stripped, runs of white space as one space, and at most `most` words."""
    t = single_spaced(text)
    return t if most is None else truncate_words(t, most, how)


#: Keys of a file's metadata that may name its author, in the order in which they are asked.
AUTHOR_KEYS = ["author", "Author", "creator", "Creator", "dc:creator"]


def author(metadata: Column) -> Column:
    """The first value of AUTHOR_KEYS in a map that isn't blank."""
    return F.coalesce(*[F.nullif(strip(metadata[k]), F.lit("")) for k in AUTHOR_KEYS])


def epoch_time(value: Column) -> Column:
    """Seconds since 1970, as text or number, as a timestamp; null for what is no number."""
    return F.timestamp_micros(F.round(value.try_cast("double") * 1e6).cast("long"))


def source_name(metadata: Column, document_id: Column, mode: str = "basename") -> Column:
    """A document's display name: source, path or file name of its metadata, else its id; basename keeps what follows the last slash."""
    filled = [F.nullif(metadata[k], F.lit("")) for k in ("source", "source_path", "file_name")]
    name = F.coalesce(*filled, document_id.cast("string"), F.lit(""))
    return F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1) if mode == "basename" else name


def uuid5(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name-based UUID (version 5) of a text in a namespace, that of URLs if not given."""
    raw = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary"))
    h = F.sha1(raw)
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), digit % 4 + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def identifier(value: Column) -> Column:
    """An id as a vector store takes it: whole numbers and UUIDs as they are (UUIDs in lower case), anything else by its name's UUID."""
    number = F.regexp_like(value, F.lit(r"^[0-9]+$"))
    own = F.regexp_like(value, F.lit(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))
    return F.when(number, value).when(own, F.lower(value)).otherwise(uuid5(value))


def chunk_name(given: Column, index: Column, content: Column) -> Column:
    """The id of a chunk that was given none: its place and the start of its content's md5."""
    return F.coalesce(given, F.concat(F.lit("chunk_"), index.cast("string"), F.lit("_"), F.substring(F.md5(content), 1, 8)))
