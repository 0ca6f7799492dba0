"""Column expressions over text: tokens, stems, codes, cleaning, chunking, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search, English and romanised Urdu.
STOP_WORDS = """
a an the of in on at to for from by with and or is are was were be been being it its this that these those as do does did
can could should would shall will may might what which who whom whose when where why how i me my we our you your he she
they them their there here about into than then so if but not no any all some tell please give show list kindly
hai hain ka ki ke ko se mein main kya kab kahan kaun kitna kitni kitne hota hoti hotay hay ho
""".split()
# Words of romanised Urdu that tell the language.
ROMAN_URDU = """
kya hai hain kab kahan kaun kitna kitni kitne mujhe mera meri hum ap aap batao bataiye chahiye karna karni krna ka ki ke ko
se mein main nahi nahin hota hoti lagta
""".split()
# Endings and what stands for them, tried in this order.
ENDINGS = [("ies", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")]
# How a course code is printed, and what looks like one but isn't.
CODE = r"(?U)\b([A-Za-z]{2,5})[-\s_]?([0-9]{3}[A-Za-z]?|[0-9][xX]{2}|[0-9]{2}[xX])\b"
NO_CODES = ["SEM", "ROOM", "TOP"]


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _pairs(text: Column) -> Column:
    """(prefix, number) of every code printed in a text."""
    both = [F.when(text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(CODE), F.lit(g))).otherwise(F.array().cast("array<string>")) for g in (1, 2)]
    return F.zip_with(*both, lambda a, b: F.struct(F.upper(a).alias("a"), F.upper(b).alias("b")))


def code(prefix: Column, number: Column) -> Column:
    """CS and CSC name the same courses."""
    return F.concat(F.when(F.upper(prefix) == "CS", "CSC").otherwise(F.upper(prefix)), F.lit("-"), F.upper(number))


def codes(text: Column) -> Column:
    """Course codes in their canonical form, each once, in order of appearance."""
    return F.array_distinct(F.transform(F.filter(_pairs(text), lambda p: ~p["a"].isin(NO_CODES)), lambda p: code(p["a"], p["b"])))


def tokens(text: Column, drop_stop: bool = True) -> Column:
    """Index words: hyphenated runs as a whole (codes in canonical form) and in parts, stems of what is
    no stop word, and then the codes of the text once more, however they are printed."""
    text = F.coalesce(text, F.lit(""))

    none = F.array().cast("array<string>")
    dropped = (lambda w: w.isin(STOP_WORDS)) if drop_stop else (lambda w: F.lit(False))

    def parts(p: Column) -> Column:
        whole = F.when(F.get(p, F.lit(1)).rlike("^[0-9]"), F.lower(code(F.get(p, F.lit(0)), F.get(p, F.lit(1))))).otherwise(F.array_join(p, "-"))
        return F.concat(F.array(whole), F.transform(F.filter(p, lambda w: ~dropped(w)), stem))

    def of(run: Column) -> Column:
        return F.when(F.contains(run, F.lit("-")), let(F.split(run, "-"), parts)).when(dropped(run), none).otherwise(F.array(stem(run)))

    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0))
    return F.concat(F.flatten(F.transform(runs, of)), F.transform(_pairs(text), lambda p: F.lower(code(p["a"], p["b"]))))


def stem(word: Column) -> Column:
    """A light English stem: the first ending that leaves three letters goes; words of four letters, of -ss or with digits stay."""
    ended = F.endswith(word, F.lit("s")) | F.endswith(word, F.lit("ing")) | F.endswith(word, F.lit("ed"))
    out = F.when((F.length(word) <= 4) | ~ended | F.endswith(word, F.lit("ss")), word).when(word.rlike("[0-9]"), word)
    for end, instead in ENDINGS:
        fits = F.endswith(word, F.lit(end)) & (F.length(word) >= len(end) + 3)
        out = out.when(fits, F.concat(F.left(word, F.length(word) - len(end)), F.lit(instead)))
    return out.otherwise(word)


def tokens_sql(text: str) -> str:
    """``tokens`` in the SQL that checks it, where word borders and \\s know ASCII only."""
    quoted = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    ends = " ".join(f"when ends_with(w, '{e}') and length(w) >= {len(e) + 3} then left(w, -{len(e)}) || '{r}'" for e, r in ENDINGS)
    stemmed = f"case when length(w) <= 4 or regexp_matches(w, '[0-9]') or ends_with(w, 'ss') then w {ends} else w end"
    canonical = lambda a, b: f"lower((case when upper({a}) = 'CS' then 'CSC' else {a} end) || '-' || {b})"
    ascii_only = f"regexp_replace(regexp_replace({text}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '__', 'g')"
    pattern = CODE.removeprefix("(?U)")
    pairs = f"list_zip(regexp_extract_all({ascii_only}, '{pattern}', 1), regexp_extract_all({ascii_only}, '{pattern}', 2))"
    whole = f"case when contains(r, '-') then [case when regexp_matches(string_split(r, '-')[2], '^[0-9]') then {canonical('string_split(r, chr(45))[1]', 'string_split(r, chr(45))[2]')} else r end] else []::varchar[] end"
    parts = f"list_transform(list_filter(string_split(r, '-'), lambda w: not list_contains({quoted}, w)), lambda w: {stemmed})"
    runs = f"regexp_extract_all(lower({text}), '[a-z0-9]+(?:-[a-z0-9]+)*')"
    return f"list_concat(flatten(list_transform({runs}, lambda r: list_concat({whole}, {parts}))), list_transform({pairs}, lambda c: {canonical('c[1]', 'c[2]')}))"


def code_list_sql(text: str) -> str:
    """The codes of a text in the SQL that checks ``codes``, repeated ones too; word borders and \\s know ASCII only there."""
    ascii_only = f"regexp_replace(regexp_replace({text}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '__', 'g')"
    part = lambda g: f"regexp_extract_all({ascii_only}, '{CODE.removeprefix('(?U)')}', {g})"
    skip = "[" + ", ".join(f"'{w}'" for w in NO_CODES) + "]"
    return f"list_transform(list_filter(list_zip({part(1)}, {part(2)}), lambda c: not list_contains({skip}, upper(c[1]))), lambda c: upper((case when upper(c[1]) = 'CS' then 'CSC' else c[1] end) || '-' || c[2]))"


def evidence_tokens(text: Column, stop: list[str]) -> Column:
    """Word runs (with a number after a hyphen) that are no stop words and more than a letter, without a plural s."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}_]+(?:-[0-9]{3})?"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(stop) & ((F.length(w) > 1) | w.rlike("^[0-9]$")))
    plural = lambda w: (F.length(w) > 4) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss"))
    return F.transform(kept, lambda w: F.when(plural(w), F.left(w, F.length(w) - 1)).otherwise(w))


def language(text: Column) -> Column:
    """ur (over 0.3 of the letters in Arabic script), roman-ur (two hint words) or en."""
    letters = F.length(F.regexp_replace(text, "\\P{L}", ""))
    arabic = F.length(F.regexp_replace(text, "[^\\u0600-\\u06ff&&\\p{L}]", ""))
    hints = F.size(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(ROMAN_URDU)))
    return F.when((letters > 0) & (arabic / letters > 0.3), "ur").when(hints >= 2, "roman-ur").otherwise("en")


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def normal_hash(text: Column) -> Column:
    """SHA-1 of the text in lower case with single spaces."""
    return F.sha1(F.lower(one_space(text)))


def stable_id(*parts: Column) -> Column:
    """16 hex digits that name a row by its parts."""
    return F.left(F.sha1(F.concat_ws("\x1f", *parts)), F.lit(16))


def drop_repeated_lines(text: Column) -> Column:
    """Lines without the next equal one, blank ends trimmed."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.aggregate(lines, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1) == x), a).otherwise(F.concat(a, F.array(x))))
    return F.array_join(kept, "\n")


def redact(text: Column) -> Column:
    """E-mail addresses, card-like and long digit runs as [redacted]."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[redacted]")
    out = F.regexp_replace(out, r"\b[0-9]{5}-[0-9]{7}-[0-9]\b", "[redacted]")
    return F.regexp_replace(out, "[0-9]{10,}", "[redacted]")


def snippet(text: Column, n: int = 240) -> Column:
    return F.left(one_space(F.regexp_replace(text, "[*#|`]", "")), F.lit(n))


# What a full stop after it does not end.
TITLES = ["Dr", "Mr", "Ms", "Mrs", "Prof", "Engr", "vs"]
# The same in a list of words, with what else goes before a name.
TITLE_WORDS = ["dr", "mr", "ms", "mrs", "prof", "professor", "engr", "sir", "madam"]
_SENTENCE_END = "(?<=[.!?])(?<!\\b(?:" + "|".join(TITLES) + ")\\.)(?<!\\be\\.g\\.)(?<!\\bi\\.e\\.)(?<!\\b[A-Z]\\.)\\s+"


def sentences(text: Column) -> Column:
    """Sentences; a title or an initial ends none."""
    return F.filter(F.transform(F.split(text, _SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """(start, piece) structs of ``size`` code points, ``overlap`` shared with the next; the last may be shorter."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct((k * step).cast("int").alias("start"), F.substring(text, (k * step + 1).cast("int"), F.lit(size)).alias("piece")))


def script_share(text: Column) -> Column:
    """Share of letters that are not ASCII."""
    every = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    plain = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(every > 0, (every - plain) / every).otherwise(0.0)


def clock_minutes(text: Column) -> Column:
    """'8:30', '08.30' or '1:35 PM' as minutes of the day; null if it is none."""
    m = lambda g: F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]{1,2})[:.]([0-9]{2})\s*(AM|PM)?$", g)
    hour, minute, half = m(1).try_cast("int"), m(2).try_cast("int"), m(3)
    hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def csv_safe(cell: Column) -> Column:
    """A quote before what a spreadsheet would run as a formula."""
    return F.when(cell.rlike(r"^[=+@]|^-(?![0-9])"), F.concat(F.lit("'"), cell)).otherwise(cell)
