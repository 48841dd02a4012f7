"""The license scan on plain strings, and against its SQL twin on awkward ones."""

import duckdb
import pytest

from crashlens.llm import license_scan
from crashlens.llm.license_texts import KNOWN_LICENSES
from crashlens.llm.oracle_sql import ORACLE_SQL

ISC, MIT, BSD3 = KNOWN_LICENSES["ISC"], KNOWN_LICENSES["MIT"], KNOWN_LICENSES["BSD-3-Clause"]


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


FOUND = {
    "as it is": (ISC, "ISC"),
    "on one line": (" ".join(ISC.split()), "ISC"),
    "one line among others": ("First.\n" + " ".join(MIT.split()) + "\nlast", "MIT"),
    "in a block comment": ("/*\n" + commented("Copyright (c) 2020, X\n\n" + ISC, " *") + "\n */\n\nint main() {}", "ISC"),
    "in hash comments": (commented("Copyright 2020 X\n\n" + MIT, "#") + "\n\nimport os", "MIT"),
    "in slashes": (commented("Copyright (C) 2019-2021 X\nAll rights reserved.\n\n" + BSD3, "//"), "BSD-3-Clause"),
    "wrapped at COPYRIGHT HOLDERS": (MIT.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT"), "MIT"),
    "wrapped at copyright notice": (MIT.replace("The above copyright", "The above\ncopyright"), "MIT"),
    "holder by a name": ("Copyright by X and others\n" + MIT, "MIT"),
    "holder by a sign": ("© X\n\n" + MIT, "MIT"),
    "bulleted": (BSD3.replace("1. ", "* ").replace("2. ", "- ").replace("3. ", "(c) "), "BSD-3-Clause"),
    "tag": ("// SPDX-License-Identifier: BSL-1.0\nint x;", "SPDX BSL-1.0"),
    "British spelling": (KNOWN_LICENSES["GPL-3.0 header"].replace("License", "Licence"), "GPL-3.0 header"),
}
NOT_FOUND = {
    "a changed duty": ISC.replace("copyright notice and this permission notice appear in all copies.",
                                  "copyright holders are paid a yearly fee for every copy."),
    "a line left out": "\n".join(MIT.split("\n")[:-1]),
    "a word added": MIT.replace("free of charge", "not free of charge"),
    "prose about one": "The MIT and the ISC License differ in length.",
}


def scan(spark, texts, known=KNOWN_LICENSES):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return license_scan.scan_licenses(docs, known).collect()


def test_plain_strings(spark):
    rows = scan(spark, [t for t, _ in FOUND.values()] + list(NOT_FOUND.values()))
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.license)
    for i, (case, (_, name)) in enumerate(FOUND.items()):
        assert found.get(i) == {name}, case
    assert not set(found) & set(range(len(FOUND), len(FOUND) + len(NOT_FOUND)))


def test_every_known_text_is_found_alone(spark):
    names = sorted(KNOWN_LICENSES)
    rows = scan(spark, [KNOWN_LICENSES[n] for n in names])
    assert {(names[r.doc_id], r.license) for r in rows if r.unit == "text"} == {(n, n) for n in names}


def test_twin_on_awkward_strings(spark):
    texts = [t for t, _ in FOUND.values()] + list(NOT_FOUND.values()) + [
        None, "", " \n\t\n", "All rights reserved.", "Copyright 2020 X\nAll rights reserved.",
        "text\r\n(c) 2020 X\r\nAll rights reserved.\r\n\r\n" + MIT.replace("\n", "\r\n"), "Copyright <year> X\n" + ISC,
        "copyright\n" + MIT, "portions copyright (c) Y\n(a) " + MIT, "(c) 2020\n(c) copyright Z\n10) " + ISC, " © x\n" + ISC]
    rows = sorted((r.doc_id, r.unit, r.unit_no, r.license, r.digest) for r in scan(spark, texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    twin = con.execute(f"SELECT doc_id, unit, unit_no, license, digest FROM ({ORACLE_SQL['op2_license_digests']})").fetchall()
    assert rows == sorted(twin)


def test_known_licences_as_a_table(spark, monkeypatch):
    known = spark.createDataFrame([("A", "Do what you like.\n\nBut be kind."), ("A again", "do WHAT you like - but be kind"),
                                   ("none", None), ("blank", " \n")], "license string, text string")
    rows = scan(spark, ["Do what you like.\n\nBut be kind.\n\nCode.", "Do what you like", None], known)
    assert sorted((r.doc_id, r.unit, r.unit_no, r.license) for r in rows) == [
        (0, "paragraphs", 0, "A"), (0, "paragraphs", 0, "A again")]
    assert scan(spark, ["x"], known.limit(0)) == []
    monkeypatch.setattr(license_scan, "MAX_FIRST_WORDS", 0)
    with pytest.raises(ValueError, match="more than 0"):
        scan(spark, ["x"], known)
