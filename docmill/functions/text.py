"""Text expressions: Unicode cleaning, token estimates, HTML, slugs and formats.

Everything is a column expression except Unicode normalisation and the decoding of
entities, which Spark lacks; to these Arrow-batched functions go only the texts
that may need them.
"""

from __future__ import annotations

import functools
import html
import html.entities
import operator
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# -- fixed values of the cleaning rules -------------------------------------------------
NO_BREAK_SPACE = "\u00a0"
LINE_SEPARATORS = "\u2028\u2029"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff"
BLOCK_TAGS = ("br", "p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
MOJIBAKE = r"(?U)(?:\ufffd|[\u0131\u2551]|º[´µº½ı]|(?<=[^\W\d_])[µ¸](?=[^\W\d_])|(?:Ã|Â)[\u0080-\u00bf]|â€[^\s])"
# -- derived from rules -----------------------------------------------------------------
CONTROLS = "".join(chr(c) for c in [*range(32), 127] if chr(c) not in "\t\n\r")
C1 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
C1_KNOWN = "".join(c for c, to in C1.items() if to)
C1_UNKNOWN = "".join(c for c, to in C1.items() if not to)
FROM = NO_BREAK_SPACE + LINE_SEPARATORS + C1_KNOWN + C1_UNKNOWN + INVISIBLE + CONTROLS
TO = " \n\n" + "".join(C1[c] for c in C1_KNOWN)
#: Unicode's white space.
WHITE = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def unaccented(s: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that it names several times and that is worked out once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def cleaned(c: Column) -> Column:
    """One ``translate`` replaces, repairs and removes; normalisation follows.

    Characters before U+0300 are normal whatever their neighbours, so only texts with others are sent to be normalised.
    """
    plain = F.translate(c, FROM, TO)
    return F.coalesce(nfc(bound(plain, lambda p: F.when(p.rlike(r"[^\x{0}-\x{2ff}]"), p))), plain)


def occurrences(c: Column, characters: str) -> Column:
    """How many of the characters a text holds; a few are quicker looked for one by one."""
    if len(characters) > 4:
        return F.length(c) - F.length(F.translate(c, characters, ""))
    each = [((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(x), F.lit("")))) / len(x.encode())).cast("int") for x in characters]
    return functools.reduce(operator.add, each)


def rules() -> dict[str, str]:
    """Name of each cleaning rule and the characters it counts."""
    out = {"no_break_space_replaced": NO_BREAK_SPACE, "unicode_line_separator_replaced": LINE_SEPARATORS, "windows_1252_control_repaired": C1_KNOWN + C1_UNKNOWN}
    out |= {f"removed_U+{ord(c):04X}": c for c in INVISIBLE}
    out |= {f"control_removed_U+{ord(c):04X}": c for c in CONTROLS}
    return out


def rule_report(df: DataFrame, text: str) -> DataFrame:
    """``(rule, changes)`` over all texts, rules without a change left out.

    One pass, without a row a character: rules of single characters are counted only
    in the texts that hold any of their kind.  The counts of a text are one array, made
    by a function of the text, which is thus worked out once.
    """
    named = list(rules().items())
    kinds = {"removed_": INVISIBLE, "control_": CONTROLS}
    alone = [(name, c) for name, c in named if not name.startswith(tuple(kinds))]
    groups = [[(name, c) for name, c in named if name.startswith(start)] for start in kinds]
    none = lambda group: F.array_repeat(F.lit(0), len(group))
    counts = lambda t, group: F.array(*[occurrences(t, c) for _, c in group])

    def of(t: Column) -> Column:
        return F.concat(counts(t, alone), *[F.when(occurrences(t, "".join(c for _, c in g)) > 0, counts(t, g)).otherwise(none(g)) for g in groups])

    each = df.select(bound(F.coalesce(F.col(text), F.lit("")), of).alias("n"))
    order = [name for group in (alone, *groups) for name, _ in group]
    sums = [F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(F.get("n", F.lit(i))), F.lit(0)).cast("bigint").alias("changes")) for i, name in enumerate(order)]
    return each.agg(F.array(*sums).alias("r")).select(F.inline("r")).where("changes > 0")


def stripped(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.btrim(c, F.lit(WHITE))


def folded(c: Column) -> Column:
    """For comparisons whatever the case: by way of capitals, which spell out what has none (and of one small sigma)."""
    return F.lower(F.translate(F.upper(c), "\u03a3", "\u03c3"))


def tokens(c: Column) -> Column:
    """A token for every two bytes begun, one at least."""
    return F.greatest(F.lit(1), F.expr("1").cast("int") * F.floor((F.octet_length(c) + 1) / 2)).cast("bigint")


def fits(c: Column, max_bytes: int, max_tokens: int) -> Column:
    return (F.octet_length(c) <= max_bytes) & (tokens(c) <= max_tokens)


def line_terminator(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r\n")), "\r\n").when(F.contains(c, F.lit("\r")), "\r").otherwise("\n")


def lines(c: Column) -> Column:
    """The lines of a text; a final line break ends the last one."""
    parts = F.split(F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c), "\n")
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.endswith(c, F.lit("\n")) | F.endswith(c, F.lit("\r")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def preferred_break(window: Column, size: Column) -> Column:
    """Where a window of ``size`` characters is best cut: after the last blank line,
    line break or space that ends in its upper half; else at its end."""
    out = size
    for mark in (" ", "\n", "\n\n"):
        from_end = F.instr(F.reverse(window), mark)
        end = F.when(from_end > 0, F.length(window) - from_end + 1)
        out = F.when((end.isNotNull()) & (end >= F.floor(size / 2)), end).otherwise(out)
    return out.cast("int")


#: What a page is made of: elements whose content is no markup, comments and declarations, tags, text, and a lone "<".
MARKUP = r"""(?is)<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[!?][^>]*+>|</?[a-z](?>[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
RAW = r"(?is)^<(?:script|style)\b[^>]*+>(.*?)(?:</(?:script|style)\s*>)?\z"


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Entities decoded twice."""
    return s.map(lambda x: x if x is None else html.unescape(html.unescape(x)))


#: An entity with its semicolon.
TERMINATED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def _whole_entities(x: str) -> str:
    return TERMINATED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0], x)


@F.pandas_udf(StringType())
def unescaped_terminated(s: pd.Series) -> pd.Series:
    """Entities that end in a semicolon decoded twice."""
    return s.map(lambda x: x if x is None else _whole_entities(_whole_entities(x)))


def html_text(c: Column | str, terminated: bool = False) -> Column:
    """Text of a page: block tags are line breaks, other tags nothing; entities are decoded twice, those in scripts once.

    The page is cut into tags and texts, each of which is turned into what it
    leaves; only pages with entities leave the JVM.  Entities without their semicolon are decoded as
    well, as HTML has it, unless only ``terminated`` ones are to be.
    """
    page = F.col(c) if isinstance(c, str) else c

    def left(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, r"^</?([a-zA-Z][^\s/>]*)", 1))
        # an ampersand that is to be decoded once is written as its entity
        raw = F.replace(F.regexp_extract(part, RAW, 1), F.lit("&"), F.lit("&amp;"))
        tag = F.when(name.isin("script", "style"), F.when(F.startswith(part, F.lit("</")), "").otherwise(raw)).when(name.isin(*BLOCK_TAGS), "\n").when((name != "") | part.rlike(r"^<[!?]"), "").otherwise(part)
        return F.when(F.startswith(part, F.lit("<")), tag).otherwise(part)

    text = F.array_join(F.transform(F.regexp_extract_all(page, F.lit(MARKUP), F.lit(0)), left), "")
    decoded = unescaped_terminated if terminated else unescaped
    text = F.coalesce(decoded(F.when(F.contains(text, F.lit("&")), text)), text)
    narrow = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?U)\n\s*\n\s*\n+", "\n\n")
    return F.when(page.isNotNull(), stripped(narrow))


def slug(c: Column) -> Column:
    """ASCII letters and digits joined by underscores, 100 characters at most."""
    plain = F.lower(F.regexp_replace(unaccented(c), r"[^\x00-\x7F]", ""))
    joined = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    short = F.substring(joined, 1, 100)
    return F.when(F.length(short) > 0, short).otherwise("conversao")


def human_size(n: Column) -> Column:
    """Bytes in the largest fitting unit of 1,024 steps (two decimals above bytes)."""
    # the shorter of two equally near decimals is the even one
    shown = lambda power: F.bround(n / float(1 << power), 2)
    out = F.format_string("%.2f TB", shown(40))
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        out = F.when(n < float(1 << (power + 10)), F.format_string(f"%.2f {unit}", shown(power))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d bytes", n.cast("bigint"))).otherwise(out)


def human_duration(seconds: Column) -> Column:
    whole = F.greatest(F.lit(0), F.bround(seconds, 0)).cast("bigint")
    return F.when(whole >= 60, F.format_string("%d min %02d s", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%d s", whole))


def mojibake(c: Column) -> Column:
    """Occurrences of sequences that UTF-8 text misread as Windows-1252 leaves."""
    return F.regexp_count(c, F.lit(MOJIBAKE))


def record_id(prefix: Column | str, *parts: Column) -> Column:
    """Prefix, underscore, and 24 hex digits of the SHA-256 of the NUL-joined parts."""
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(start, F.lit("_"), F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, 24))
