"""Column expressions on text: all built-in functions, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation. Fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word, or one sign that is neither word nor white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def unix_lines(text: str | Column) -> Column:
    r"""``\r\n`` and ``\r`` as ``\n``."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines(text: str | Column) -> Column:
    """The lines of a text, a trailing empty one included."""
    return F.split(unix_lines(text), "\n", -1)


def shown_lines(text: str | Column) -> Column:
    """The lines of a text as an editor counts them: no trailing empty one; also broken at the rarer line separators."""
    cut = F.regexp_replace(unix_lines(text), "[\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]", "\n")
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(cut, r"\n\z", ""), "\n", -1))


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def blank_separated(text: str | Column) -> Column:
    """The stretches of a text without ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def n_tokens(text: str | Column) -> Column:
    return F.size(tokens(text)).cast("long")


def sentence_lines(text: str | Column) -> Column:
    """A line end in place of the blank after ``.``, ``?`` and ``!``."""
    return F.regexp_replace(text, r"([.?!]) ", "$1\n")


def without_punctuation(text: str | Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def is_alphabetic(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def first_words(text: str | Column, n: int = 5) -> Column:
    return F.array_join(F.slice(blank_separated(text), 1, n), " ")


def has_non_ascii(text: str | Column) -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike(r"[^\x00-\x7F]")


def index_row(n: Column, line: Column, name: Column) -> Column:
    """``n) line - name``."""
    return F.concat(n.cast("string"), F.lit(") "), line.cast("string"), F.lit(" - "), name)


def index_line(row: str) -> Column:
    """The line number in the index row of column ``row``; NULL where there is none."""
    return F.expr(f"try_cast(nullif(regexp_extract({row}, '\\\\)\\\\s+(\\\\d+)\\\\s+-', 1), '') AS bigint)")


def rerooted(path: str | Column, drop: int = 2, ending: str = ".txt") -> Column:
    """A path without its first folders and with another ending added."""
    return F.concat(F.array_join(F.slice(F.split(path, "/"), drop + 1, 1_000_000), "/"), F.lit(ending))


def stem(path: str | Column) -> Column:
    """A file name without folders and without its last ending; a leading or trailing dot is no ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def wrapped(text: str | Column, start: str = "<|startoftext|>", end: str = "<|endoftext|>") -> Column:
    return F.concat(F.lit(start), text, F.lit(end))


def duration(seconds: str | Column) -> Column:
    """``H:MM:SS``, from a day on with ``1 day, `` or ``n days, `` before it; rounded half to even."""
    s = F.bround(seconds, 0).cast("long")
    days, rest = F.floor(s / 86400), F.pmod(s, F.lit(86400))
    clock = F.concat(F.floor(rest / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(rest % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((rest % 60).cast("string"), 2, "0"))
    return F.concat(F.when(days == 0, "").when(F.abs(days) == 1, F.concat(days.cast("string"), F.lit(" day, "))).otherwise(F.concat(days.cast("string"), F.lit(" days, "))), clock)


def seconds(said: str) -> Column:
    """The seconds that ``duration`` wrote; NULL for anything else."""
    part = lambda g: f"try_cast(nullif(regexp_extract({said}, '^(?:(-?\\\\d+) days?, )?(\\\\d+):(\\\\d\\\\d):(\\\\d\\\\d)$', {g}), '') AS bigint)"
    return F.expr(f"coalesce({part(1)}, 0) * 86400 + {part(2)} * 3600 + {part(3)} * 60 + {part(4)}")


def decimals(x: str | Column, n: int) -> Column:
    """A number with ``n`` decimals and no separators."""
    return F.format_string(f"%.{n}f", F.col(x) if isinstance(x, str) else x)


def stamped(at: str | Column) -> Column:
    """A time as part of a name: month, day and year, ``T``, hours, minutes and seconds, with hyphens."""
    return F.date_format(at, "MM-dd-yyyy'T'HH-mm-ss")


def grouped_number(n: str | Column, width: int = 5) -> Column:
    """A whole number with thousands separators, padded on the left to ``width``, never cut."""
    said = F.format_number(n, 0)
    return F.when(F.length(said) < width, F.lpad(said, width, " ")).otherwise(said)
