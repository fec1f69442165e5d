"""Rules of text, mail, delimited files and cutting, case by case or against a plain version."""

import random
from email import message_from_bytes

import pytest

from docmill.functions import text as tx
from docmill.functions.decoding import decode
from docmill.operators import packing
from docmill.sources import csv, mbox


def test_marks_name_the_encoding():
    for label in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        assert decode("﻿maçã".encode(label)) == ("maçã", label, [])
    assert decode(b"\xef\xbb\xbfkiwi") == ("kiwi", "utf-8", []) and decode(b"") == ("", "utf-8", []) and decode("uva é".encode()) == ("uva é", "utf-8", [])
    with pytest.raises(UnicodeDecodeError):
        decode(b"\xef\xbb\xbf\xff\xfe")  # belies its mark


PAGES = [
    ("<p>one</p><p>two</p>", "one\n\ntwo"),
    ("a<br/>b<BR >c", "a\nb\nc"),
    ("x &amp;lt; y &eacute; &#233; &nope;", "x < y é é &nope;"),
    ("<script>if (a &amp;&amp; b < c) { '<p>' }</script>z", "if (a && b < c) { '<p>' }z"),
    ("<style>\nb > i {}\n</style><title>T</title>", "b > i {}\nT"),
    ("<!-- <p>no</p> -->a<!DOCTYPE html>b<?php x ?>c", "abc"),
    ('<a href="x>y" title=\'<p>\'>link</a> 1 < 2', "link 1 < 2"),
    ("a\n \n\t\n\n\nb   c\t d", "a\n\nb c d"),
    ("<li> in </li>", "in"),
    ("<custom-tag>k</custom-tag><H3>h</H3>", "k\nh"),
    ("", ""),
    (None, None),
]


def test_pages_become_text(spark):
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "i int, h string")
    got = {r.i: r.t for r in frame.select("i", tx.html_text("h").alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    long = "<div class='" + "k " * 50_000 + "'>" + "<b>w</b> " * 50_000
    assert spark.createDataFrame([(long,)], "h string").select(tx.html_text("h")).first()[0] == ("w " * 50_000).strip()


def test_white_space_is_stripped_like_unicode_says(spark):
    rows = [(" \x85a b 　",), ("",), (" \t\n",), ("​x",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.stripped(tx.F.col("t"))).collect()] == ["a b", "", "", "​x"]
    names = [("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος"), ("Ünit", "üNIT")]
    folded = spark.createDataFrame(names, "a string, b string").select(tx.folded(tx.F.col("a")), tx.folded(tx.F.col("b"))).collect()
    assert all(a == b for a, b in folded)


def test_rules_are_counted_like_characters(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab   \u0081\u0080​﻿­\x01\x7f\n", k=40)) for _ in range(200)]
    want = {}
    for name, characters in tx.rules().items():
        if n := sum(t.count(c) for t in texts for c in characters):
            want[name] = n
    frame = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    assert {r.rule: r.changes for r in tx.rule_report(frame, "t").collect()} == want
    assert spark.createDataFrame([("é Å",), ("plain é",)], "t string").select(tx.cleaned(tx.F.col("t")).alias("c")).collect()[0].c == "é Å"


MESSAGE = b"""From: =?utf-8?q?Ferreira=2C_Rui?= <rui@garden.test>
To: "Olive, Ann" <ann@garden.test>
To: bob@garden.test, <>
Subject: =?bad?x?no
Date: 1 Feb 2031 08:30:00
References: <r1@garden.test> junk <r2@garden.test>
References: r3 r4
X-Gmail-Labels: "Seeds, dry",Open
X-Gmail-Labels: Late,, "kept" so
Content-Type: text/plain; charset=made-up

\x93quoted\x94
"""


def test_headers_are_all_read_and_words_before_addresses():
    made = dict(zip([f.split()[0] for f in mbox.SCHEMA.split(", ")[3:]], mbox.fields(MESSAGE), strict=False))
    msg = message_from_bytes(MESSAGE)
    # the comma of an encoded word parts addresses, since words are read first
    assert [p["email"] for p in mbox.people(msg, "From")][-1] == "rui@garden.test" and len(mbox.people(msg, "From")) == 2
    assert mbox.people(msg, "To") == [{"name": "Olive, Ann", "email": "ann@garden.test"}, {"name": "", "email": "bob@garden.test"}]
    fields = mbox.fields(MESSAGE)
    assert ["<r1@garden.test>", "<r2@garden.test>", "r3", "r4"] in fields and ["Seeds, dry", "Open", "Late", '"kept" so'] in fields
    assert "2031-02-01T08:30:00+00:00" in fields and "“quoted”\n" in fields and fields[-1] is None and made


def test_dates_and_parts_that_cannot_be_read():
    assert mbox.iso_date("Thu, 13 Mar 2031 10:00:00 +0530") == "2031-03-13T10:00:00+05:30"
    assert mbox.iso_date("13 Mar 2031 10:00:00 -0000") == "2031-03-13T10:00:00+00:00"
    assert mbox.iso_date("32 Foo 2031") is None and mbox.iso_date("99 Mar 2031 10:00:00 +0000") is None and mbox.iso_date(None) is None and mbox.iso_date("") is None
    assert mbox.content(message_from_bytes(b"Content-Type: text/plain; charset=utf-8\n\n\xe9t\xe9")) == "été"
    assert mbox.labels('a,"b ""c"", d",e\n f') == ["a", '"b ""c""', 'd"', "e\n f"] and mbox.labels('"b ""c"", d"x,e') == ['b "c", dx', "e"] and mbox.labels("") == []


def test_likeliest_delimiter():
    assert csv.likeliest("pear;1;2\nfig;3,5;4\nplum;5;6\n") == ";"
    assert csv.likeliest('"a,b";1\n"c,d";2\n') == ";" and csv.likeliest('x,"1,2"\ny,"4,5,6"\n') == ","
    assert csv.likeliest("a|b\nc|d\n\n   \n") == "|" and csv.likeliest("word\nword\n") is None
    assert csv.likeliest("a,b;c\nd,e;f\n") == ","  # equals: the first
    assert csv.dialect_of("word\n") == ({"delimiter": ",", "quotechar": '"', "doublequote": True, "skipinitialspace": False}, ["csv_dialect_detection_failed_comma_assumed"])


def test_header_sample_is_the_first_characters(spark, tmp_path):
    # over 5,000 short rows lie within the sample; the first number stands after them
    (tmp_path / "many.csv").write_text("k,v\n" + "a,b\n" * 9000 + "c,1\n")
    (tmp_path / "beyond.csv").write_text("k,k\n" + "a,b\n" * 30_000 + "c,1\n")
    found = {f.dataset: f.has_header for f in csv.read(spark, str(tmp_path))["files"].collect()}
    assert found == {"many.csv": True, "beyond.csv": False}


def longest(body, name, limit, at, line, number):
    fit = [n for n in range(1, len(body) - at + 1) if len(packing.render(name, body[at : at + n], line, line + body[at : at + n].count("\n"), number, packing.UNKNOWN_COUNT).encode()) <= limit]
    return max(fit, default=0)


def test_cuts_are_the_longest_that_fit():
    rng = random.Random(11)
    for _ in range(300):
        body = "".join(rng.choices(["a", "bc ", " ", "\n", "\n\n", "é", "漢", "🙂", " "], k=rng.randint(0, 300)))
        limit = rng.choice([60, 75, 90, 200])
        name = rng.choice(["", "n.txt"])
        chunks, over = packing.cut_to_fit(body, name, limit)
        at, line = 0, 1
        for i, (start, stop) in enumerate(chunks, 1):
            if not body:
                break
            n = longest(body, name, limit, at, line, i)
            assert start == at and (stop == at + packing.best_break(body[at : at + n]) if n else over and stop == len(body))
            line += body.count("\n", at, stop)
            at = stop
        assert at == len(body)


def test_best_break_is_in_the_upper_half():
    assert packing.best_break("aaaa bbbb") == 5 and packing.best_break("a bbbbbbb") == 9
    assert packing.best_break("aaaaaa\n\nbb c") == 8 and packing.best_break("aaaaaa\nbb c ") == 7 and packing.best_break("x") == 1


def test_mail_pieces_fit_with_their_escapes(spark):
    import json

    rng = random.Random(12)
    bodies = ["".join(rng.choices(['"', "\\", "\n", "\x01", "é", "🙂", "a", "b "], k=rng.randint(0, 400))) for _ in range(60)] + [None]
    frame, limit = 50, 90
    rows = spark.createDataFrame([(i, b, frame) for i, b in enumerate(bodies)], "k int, b string, f int")
    by = {}
    for r in packing.mail_segments(rows, "k", "b", "f", limit).collect():
        by.setdefault(r.k, []).append(r)
    size = lambda t, n: frame + len(json.dumps(t, ensure_ascii=False).encode()) - 2 + len(str(n)) - 1
    for i, body in enumerate(bodies):
        body, parts = body or "", sorted(by[i], key=lambda r: r.segment)
        pieces = [body[r.start : r.start + r.length] for r in parts]
        assert "".join(pieces) == body and all(r.segments == len(parts) and not r.oversized for r in parts)
        for n, (r, piece) in enumerate(zip(parts, pieces, strict=True), 1):
            assert size(piece, n) <= limit and (n == len(parts) or size(body[r.start : r.start + r.length + 1], n) > limit)
    hopeless = packing.mail_segments(rows.where("length(b) > 0"), "k", "b", "f", 50).collect()
    assert all(r.oversized and r.segments == 1 for r in hopeless)


def test_tables_are_cut_between_rows(spark):
    tables = [(1, ["| a |", "| - |", *[f"| {i} |" for i in range(40)]]), (2, ["| a |", "| - |"]), (3, ["| a |", "| - |", "| " + "x" * 100 + " |", "| 1 |"]), (4, ["| a |", "| - |", "| 1 |"])]
    got = packing.table_segments(spark.createDataFrame([(k, t, 10) for k, t in tables], "k int, l array<string>, f int"), "k", "l", "f", 60).collect()
    for k, lines in tables:
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.segment)
        if k == 3:
            assert [(r.row_start, r.row_end, r.fits) for r in mine] == [(1, 2, False)]
            continue
        size = lambda a, b, n: 10 + len("\n".join([*lines[:2], *lines[1 + a : 2 + b]])) + len(str(n)) - 1  # noqa: B023, E731
        assert [x for r in mine for x in range(r.row_start, r.row_end + 1)] == list(range(1, len(lines) - 1)) and all(r.fits for r in mine)
        assert all(size(r.row_start, r.row_end, r.segment) <= 60 for r in mine) and all(size(r.row_start, r.row_end + 1, r.segment) > 60 for r in mine[:-1])
