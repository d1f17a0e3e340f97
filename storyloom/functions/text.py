"""Text expressions: name keys, tokens, script lines. All are Column -> Column, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
ARTICLES = ("the", "a", "an")
DETERMINERS = ("the", "a", "an", "my", "his", "her", "their", "this", "that", "these", "those", "our", "your")
POSSESSIVES = ("the", "a", "an", "my", "his", "her", "their")
VAGUE_NAMES = (
    "bit", "business", "day", "hand", "hour", "idea", "night", "one", "other hand", "place", "school", "something", "sound", "thing", "time", "voice", "way",
)
GENERIC_ALIASES = (
    "animal", "artifact", "bird", "book", "box", "cabinet", "car", "creature", "figure", "item", "machine", "object", "person", "prop", "thing", "tool", "vehicle",
)
STOPWORDS = (
    "a", "an", "and", "at", "day", "ext", "for", "from", "in", "int", "into", "later", "moment", "moments", "night", "of", "on", "room", "scene", "the", "to",
)
DIRECTIONS = ("CUT TO", "DISSOLVE TO", "FADE IN", "FADE OUT", "MONTAGE", "OMITTED")
CLAUSE_WORDS = ("for", "to", "and", "but", "if", "when", "while", "because", "that", "who", "which")
JUNK_LINES = (
    r"^\s*\(CONTINUED\)", r"\bCONTINUED:\b", r"^\s*FADE\s+(?:IN|OUT)\b", r"^\s*CUT\s+TO\b", r"^\s*DISSOLVE\s+TO\b", r"^\s*Rev\.\s*", r"^HARRY\s+POTTER\b", r"^\s*PAGE\s+\d+\s*$",
)
HEADING = r"^\s*(\d{1,3}[A-Z]?)\.?\s+(OMITTED|(?:INT|EXT)\.?\s*/\s*(?:INT|EXT)\.?|INT\.?|EXT\.?)\s*(.*)$"
NEAR_HEADING = r"(?i)^\s*\d{1,3}[A-Z]?\s+.*\b(INT|EXT)\b"
NOUN_AFTER_DETERMINER = r"\b(?:a|an|the|my|his|her|their|this|that|these|those|our|your)\s+([A-Za-z][A-Za-z' -]{1,48})"
TITLE_CASE_NAME = r"\b([A-Z][a-z']+(?:\s+[A-Z][a-z']+){1,3})\b"
NAME_EDGES = " ,.;:!?()[]{}\"'"


def strip(c: Column) -> Column:
    """White space of any kind cut from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _key(c: Column, leading: tuple[str, ...], keep: str = "'") -> Column:
    """A single word of plain letters, digits, ``_`` and ``'`` is its own key."""
    low = F.regexp_replace(F.lower(strip(c)), rf"(?U)^(?:{'|'.join(leading)})\s+", "")
    key = F.regexp_replace(F.regexp_replace(low, rf"(?U)[^\w\s{keep}]+", ""), r"(?U)\s+", " ")
    return F.when(c.rlike(r"\A[a-z0-9_']*\z"), c).otherwise(key)


def mention_key(c: Column) -> Column:
    """Key under which mentions are aggregated: one leading article dropped; a space left at an end stays."""
    return _key(c, ARTICLES)


def alias_key(c: Column) -> Column:
    """Key of an alias across scenes: one leading article dropped, ends trimmed."""
    return F.trim(_key(c, ARTICLES))


def object_key(c: Column) -> Column:
    """Key of an object within a scene: one leading determiner or possessive dropped, ends trimmed."""
    return F.trim(_key(c, DETERMINERS))


def chunk_key(c: Column) -> Column:
    """Key of a noun chunk: hyphens are kept."""
    return squeeze(F.lower(_key(squeeze(c), POSSESSIVES, r"\-'")))


def bare_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def file_slug(c: Column) -> Column:
    """A name for files: spaces as ``_``, letters, digits, ``_`` and ``-`` kept, ``object`` if nothing is left."""
    s = F.regexp_replace(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_")), r"(?U)[^\p{L}\p{N}_-]", "")
    return F.when(F.length(s) > 0, s).otherwise("object")


def keys_of(values: Column, key) -> Column:
    """The distinct non-empty keys of an array of names, in order."""
    return F.array_distinct(F.filter(F.transform(F.filter(F.array_distinct(values), lambda v: v.isNotNull()), key), lambda k: k != ""))


def is_generic(key: Column) -> Column:
    """Of a key: empty, or too general to tell objects apart."""
    return (key == "") | key.isin(*GENERIC_ALIASES)


def specific(keys: Column) -> Column:
    return F.filter(keys, lambda k: ~is_generic(k))


def name_rank(name: Column) -> Column:
    """How telling a name is: specific before generic, then more words, then longer; -1s for an empty one."""
    return key_rank(alias_key(name))


def key_rank(k: Column) -> Column:
    """``name_rank`` of a name by its alias key, which is read several times: keep it as a column of a written table, not as an expression."""
    rank = lambda a, b, c: F.struct(a.cast("int").alias("specific"), b.cast("int").alias("words"), c.cast("int").alias("size"))
    return F.when(F.coalesce(k, F.lit("")) == "", rank(F.lit(-1), F.lit(-1), F.lit(-1))).otherwise(
        rank(F.when(is_generic(k), 0).otherwise(1), F.size(F.split(k, " ")), F.length(k))
    )


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 1))


def is_junk_line(line: Column) -> Column:
    """Layout that isn't story text; blank lines are not junk."""
    return (strip(line) != "") & line.rlike("(?i)" + "|".join(JUNK_LINES))


def is_speaker_line(line: Column) -> Column:
    s = squeeze(line)
    return F.length(s).between(2, 32) & ~s.isin(*DIRECTIONS) & s.rlike(r"^[A-Z][A-Z \-'.]+$")


def heading_parts(line: Column) -> Column:
    """Label, kind and rest of a scene heading; null for any other line."""
    s = strip(line)
    part = lambda i: F.regexp_extract(s, HEADING, i)
    return F.when(s.rlike(HEADING), F.struct(part(1).alias("label"), marker_kind(part(2)).alias("kind"), part(3).alias("rest")))


def marker_kind(raw: Column) -> Column:
    tidy = F.regexp_replace(squeeze(raw), r"\s*/\s*", "/")
    bare = F.replace(F.upper(tidy), F.lit("."), F.lit(""))
    return F.when(bare == "OMITTED", bare).when(bare.isin("INT", "EXT", "INT/EXT", "EXT/INT"), F.concat(bare, F.lit("."))).otherwise(tidy)


def heading_text(kind: Column, rest: Column, label: Column) -> Column:
    """Kind and rest, without the label's number if the heading repeats it at its end."""
    number = F.regexp_extract(label, r"^\d{1,3}", 0).cast("int").cast("string")
    r = squeeze(rest)
    tail = F.regexp_extract(r, r"\s(\d+)$", 1)
    r = F.when(tail == number, strip(F.regexp_replace(r, r"\s+\d+$", ""))).otherwise(r)
    return squeeze(F.concat_ws(" ", kind, r))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space; empty ones are left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def spoken_names(sentence: Column) -> Column:
    """Names that a sentence mentions: what follows a determiner, then names in title case, cut at a clause word."""
    raw = F.concat(F.regexp_extract_all(sentence, F.lit("(?U)" + NOUN_AFTER_DETERMINER), F.lit(1)), F.regexp_extract_all(sentence, F.lit("(?U)" + TITLE_CASE_NAME), F.lit(1)))
    cut = F.transform(raw, lambda n: F.element_at(F.split(strip(n), rf"\b(?:{'|'.join(CLAUSE_WORDS)})\b", 2), 1))
    return F.transform(cut, lambda n: F.btrim(n, F.lit(NAME_EDGES)))


def is_spoken_object(key: Column) -> Column:
    return (F.length(key) >= 3) & ~key.isin(*VAGUE_NAMES)


def timecode_seconds(code: Column) -> Column:
    """``HH:MM:SS,mmm`` or ``HH:MM:SS.mmm`` as seconds."""
    part = lambda i: F.regexp_extract(code, r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})$", i).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / F.lit(1000.0)


def clock(seconds: Column) -> Column:
    """Seconds as ``HH:MM:SS``, rounded half to even."""
    t = F.rint(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(t / 3600), F.floor(F.pmod(t, F.lit(3600)) / 60), F.pmod(t, F.lit(60)))
