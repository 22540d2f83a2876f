"""Matching keys, splits and path parts as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to one letter, and to two.
FOLDS = {
    "a": "àáâãäåāăą", "c": "çćč", "e": "èéêëēėęě", "i": "ìíîïīį", "n": "ñńň", "o": "òóôõöøōő", "u": "ùúûüūůű",
    "y": "ýÿ", "z": "žźż", "s": "šś", "r": "ř", "l": "ł", "d": "đð", "t": "ť",
}
DOUBLE_FOLDS = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}
#: Articles that keys leave out and sort names move.
ARTICLES = ("the", "le", "la", "les", "der", "die")
#: What stands between a name and its guest, and between two names.
GUEST_MARKS = ("feat.", "feat", "featuring", "ft.", "ft", "avec", "with", "vs.")
NAME_SEPARATORS = (";", " / ", "//")
#: Keys that stand for no artist in particular.
PLACEHOLDERS = ("various artists", "various", "va", "artistes divers", "divers", "multi interpretes")

FROM = "".join(FOLDS.values())
TO = "".join(k * len(v) for k, v in FOLDS.items())


def fold(x: Column) -> Column:
    """Lower-cased ``x`` without the diacritics of the table above; text of one byte a character holds none.

    The rare case stands in a lambda: generated code that holds it in full grows beyond what the JVM compiles.
    """
    def full(s: Column) -> Column:
        out = F.translate(F.lower(s), FROM, TO)
        for a, b in DOUBLE_FOLDS.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.get(F.transform(F.array(x), full), F.lit(0)))


def normalize(x: Column) -> Column:
    """Matching key: folded, one space for each run of other characters, less one article, at the end or else in front.

    Each step is named once: inside lambdas Spark evaluates an expression as often as it is written.
    """
    plain = F.trim(F.regexp_replace(fold(F.trim(x)), r"[^\p{IsAlphabetic}\p{N}]+", " "))
    names = "|".join(ARTICLES)
    return F.regexp_replace(plain, rf" (?:{names})$|^(?=(?:{names}) )(?!.+ (?:{names})$)(?:{names}) ", "")


def is_placeholder(x: Column) -> Column:
    return normalize(x).isin(*PLACEHOLDERS)


def sort_name(x: Column) -> Column:
    """``The Rest`` as ``Rest, The``."""
    return F.regexp_replace(x, rf"(?is)^({'|'.join(ARTICLES)}) \s*(.*?)\s*$", "$2, $1")


#: What parts a field into names, and what stands at the ends of a name that is not clean.
_GUESTS = "|".join(m.replace(".", r"\.") for m in sorted(GUEST_MARKS, key=len, reverse=True))
_PARTED = rf";|//| (?:/|{_GUESTS}) "
_UNCLEAN = "(?:^|\u0001)(?:[ ,\\-\u0001]|$)|[ ,\\-]\u0001|[ ,\\-]$"


def split_names(x: Column) -> Column:
    """Names in one field: split at separators, then once at the first guest mark, trimmed, each once."""
    parts = F.split(F.trim(x), r";| / |//")
    guests = F.transform(parts, lambda p: F.split(p, rf"(?i) (?:{_GUESTS}) ", 2))
    clean = F.transform(F.flatten(guests), lambda p: F.trim(F.btrim(F.trim(p), F.lit(",-"))))
    return F.array_distinct(F.filter(clean, lambda p: p != ""))


def names_of(values: Column) -> Column:
    """The names in all values of a field.  Values that are clean names stay as they are, which one look at all of them tells."""
    told = F.array_join(values, "\u0001", ";")  # a missing value is no clean name
    return F.when(told.rlike(f"(?i){_PARTED}|{_UNCLEAN}"), F.flatten(F.transform(values, split_names))).otherwise(values)


def maybe_placeholder(names: Column) -> Column:
    """False only if none of the names can be a placeholder: plain letters that hold no beginning of one."""
    told = F.array_join(names, " ", ";")
    return (F.octet_length(told) != F.char_length(told)) | told.rlike("(?i)va|div|art|mult")


def extract_year(x: Column) -> Column:
    """The first four digits that make a year of 1500 to 2200."""
    return F.nullif(F.regexp_extract(x, r"(1[5-9]\d\d|2[01]\d\d|2200)", 1), F.lit("")).try_cast("int")


def number_of_total(x: Column) -> tuple[Column, Column]:
    """``5/12`` as two numbers; what is no number is null."""
    part = lambda i: F.nullif(F.regexp_extract(F.get(F.split(x, "/"), F.lit(i)), r"^\s*\+?([0-9]+)\s*$", 1), F.lit("")).try_cast("int")
    return part(0), part(1)


def format_duration(ms: Column) -> Column:
    """``m:ss`` or ``h:mm:ss`` of rounded seconds."""
    total = F.floor((ms + 500) / 1000)
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))


def format_rate(hz: Column) -> Column:
    """``48 kHz``, ``44.1 kHz``: one decimal unless it is a whole number."""
    tenths = F.floor((hz + 50) / 100).cast("long")
    whole = F.floor(tenths / 10).cast("string")
    return F.concat(F.when(hz % 1000 == 0, whole).otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("string"))), F.lit(" kHz"))


def position(disc: Column, track: Column) -> Column:
    """``disc 2, track 5``, as far as it is known."""
    part = lambda n, word: F.when(n.isNotNull(), F.concat(F.lit(f"{word} "), n.cast("string")))
    return F.nullif(F.concat_ws(", ", part(disc, "disc"), part(track, "track")), F.lit(""))


def format_size(size: Column) -> Column:
    """Decimal units with one decimal, halves up; bytes below 1000 as they are."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        tenths = F.floor((size + 1000**k // 20) / (1000**k // 10)).cast("long")
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= 1000**k, shown).otherwise(out)
    return out


def long_duration(ms: Column) -> Column:
    """``1 d 1 h 0 min``, ``2 h 5 min``, ``2 min 0 s`` or ``40 s``."""
    s = F.floor((ms + 500) / 1000)
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f" {unit}"))
    hours, minutes = part(F.floor(s % 86400 / 3600), "h"), part(F.floor(s % 3600 / 60), "min")
    return F.when(s >= 86400, F.concat_ws(" ", part(F.floor(s / 86400), "d"), hours, minutes)).when(s >= 3600, F.concat_ws(" ", hours, minutes)).when(s >= 60, F.concat_ws(" ", minutes, part(s % 60, "s"))).otherwise(part(s, "s"))


def resolved(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty parts; above the root there is nothing."""
    none = F.expr("cast(array() as array<string>)")
    up = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    parts = F.aggregate(F.split(path, "/"), none, lambda s, x: F.when(x.isin("", "."), s).when(x == "..", up(s)).otherwise(F.concat(s, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def folder(path: Column) -> Column:
    """What stands before the last slash."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def title_of_path(path: Column) -> Column:
    """The file name without extension, leading digits and what divides them from the title."""
    title = F.trim(F.regexp_replace(stem(path), r"^[0-9]*[ \-._]*", ""))
    return F.coalesce(F.nullif(title, F.lit("")), stem(path))


def number_of_path(path: Column) -> Column:
    """One to three leading digits of the file name, if they make a number over 0."""
    n = F.nullif(F.regexp_extract(file_name(path), r"^([0-9]{1,3})(?![0-9])", 1), F.lit("")).try_cast("int")
    return F.when(n > 0, n)


def is_under(path: Column, place: Column) -> Column:
    """``path`` is ``place`` or inside it; a name is never cut in the middle."""
    return (path == place) | path.startswith(F.concat(F.regexp_replace(place, "/$", ""), F.lit("/")))


def search_score(key: Column, needle: Column) -> Column:
    """0 equal, 1 in front, 2 inside, else null; an empty needle finds nothing."""
    return F.when(needle == "", F.lit(None).cast("int")).when(key == needle, 0).when(key.startswith(needle), 1).when(key.contains(needle), 2)


def csv_field(x: Column, sep: str = ",") -> Column:
    """A field of RFC 4180: in quotes only where it holds a separator, a quote or a line end."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    held = text.contains(sep) | text.contains('"') | text.contains("\n") | text.contains("\r")
    return F.when(held, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: list[Column], sep: str = ",") -> Column:
    return F.concat_ws(sep, *[csv_field(c, sep) for c in columns])
