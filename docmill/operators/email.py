"""Messages: identity and the compact form that is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters of the body that the fingerprint takes.
FINGERPRINT_CHARACTERS = 1000


def people_text(people: Column) -> Column:
    """An address list (``array<struct<name, email>>``) in the notation its fingerprint uses; empty for none."""

    def quoted(c: Column) -> Column:
        plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
        return F.when(c.isNull(), "None").when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))

    one = lambda p: F.concat(F.lit("{'name': "), quoted(p["name"]), F.lit(", 'email': "), quoted(p["email"]), F.lit("}"))
    return F.when(F.size(people) > 0, F.concat(F.lit("["), F.array_join(F.transform(people, one), ", "), F.lit("]"))).otherwise("")


def generated_id(date_raw: Column, people: Column, subject: Column, body: Column) -> Column:
    """The id of a message that has none."""
    none = lambda c: F.coalesce(c, F.lit(""))
    parts = F.concat_ws("|", none(date_raw), people_text(people), none(subject), F.substring(none(body), 1, FINGERPRINT_CHARACTERS))
    return F.concat(F.lit("generated:"), F.sha2(parts, 256))


def references(c: Column) -> Column:
    """All ``<...>`` tokens, else the words."""
    found = F.regexp_extract_all(c, F.lit("(<[^>]+>)"), F.lit(1))
    words = F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda w: w != "")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(words)


def _json(c: Column) -> Column:
    """A JSON literal, null included."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(whole.substr(F.lit(2), F.length(whole) - 2))


def _people(c: Column) -> Column:
    one = lambda p: F.concat(F.lit('{"name":'), _json(p["name"]), F.lit(',"email":'), _json(p["email"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<name:string,email:string>>")), one), ","), F.lit("]"))


def compact(m: dict[str, Column]) -> Column:
    """The JSON of a message: date, from, to, subject and body always, the rest where it is not empty.

    ``m`` names columns: date, from, to, subject, body, and any of cc, bcc (people),
    thread_id, html, attachments (``array<struct<file_name, media_type>>``),
    segment_number and segment_count.
    """
    parts = [
        F.concat(F.lit('"date":'), _json(m["date"])), F.concat(F.lit('"from":'), _people(m["from"])), F.concat(F.lit('"to":'), _people(m["to"])),
        F.concat(F.lit('"subject":'), _json(m["subject"])), F.concat(F.lit('"body":'), _json(F.coalesce(m["body"], F.lit("")))),
    ]
    for k in ("cc", "bcc"):
        if k in m:
            parts.append(F.when(F.size(m[k]) > 0, F.concat(F.lit(f'"{k}":'), _people(m[k]))))
    for k in ("thread_id", "html"):
        if k in m:
            parts.append(F.when(F.coalesce(m[k], F.lit("")) != "", F.concat(F.lit(f'"{k}":'), _json(m[k]))))
    if "attachments" in m:
        field = lambda a, k: F.when(F.coalesce(a[k], F.lit("")) != "", F.concat(F.lit(f'"{k}":'), _json(a[k])))
        one = lambda a: F.concat(F.lit("{"), F.concat_ws(",", field(a, "file_name"), field(a, "media_type")), F.lit("}"))
        parts.append(F.when(F.size(m["attachments"]) > 0, F.concat(F.lit('"attachments":['), F.array_join(F.transform(m["attachments"], one), ","), F.lit("]"))))
    if "segment_number" in m:
        parts.append(F.when(m["segment_number"].isNotNull() & m["segment_count"].isNotNull(), F.format_string('"segment":"%d/%d"', m["segment_number"], m["segment_count"])))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
