from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from topicweave.llm import licenses
from topicweave.llm.license_texts import LICENSES


def test_variants_of_whole_texts(make_docs):
    mit = dict(LICENSES)["MIT"]
    plain = next(text for name, text in LICENSES if name == "ISC")
    docs = {1: mit, 2: f"Copyright (c) 2020 Some Body\n\n{mit.upper()}", 3: mit.replace("\n", "\r\n  ").replace(",", " ,"),
            4: mit + " extra", 5: "Copyright 1999 X\n(c) Y\n" + plain, 6: mit.replace("sublicense", "sub-licence"),
            7: "Released under the MIT Licence", 8: "© 2001", 9: None, 10: "a " * 100_000}
    found = {r["doc_id"]: r for r in licenses.scan(make_docs(docs, license_id="x", digest="y")).collect()}
    assert {i: r["license_id"] for i, r in found.items()} == {
        1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "ISC", 6: "MIT", 7: "MIT-notice", 8: None, 9: None, 10: None}
    assert found[9]["digest"] is None and found[1]["digest"] == found[2]["digest"] and len(found[8]["digest"]) == 64


def test_odd_rows_and_own_licences(spark, odd_docs, no_docs):
    assert licenses.scan(odd_docs).count() == 11 and licenses.scan(no_docs).count() == 0
    known = spark.createDataFrame([("b", "ONE."), ("a", "one"), ("c", ""), ("d", None)], "license_id string, text string")
    found = licenses.scan(odd_docs, known).where(F.col("license_id").isNotNull()).collect()
    assert sorted((r["doc_id"], r["license_id"]) for r in found) == [(4, "a"), (4, "a"), (5, "a")]
    plan = licenses.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0", "LGPL-2.1"])
def test_whole_long_texts(make_docs, name):
    text = next(text for i, text in LICENSES if i == name)
    header = "Copyright 2020 Jane Doe\nCopyright Jane Doe 2021\n  Copyright: 2022 Jane Doe\n# Copyright The Some Authors\nAll rights reserved.\n"
    docs = {1: text, 2: header + text, 3: text.replace("\n", "\r\n"), 4: text[:-200], 5: text.replace("license", "licence")}
    found = {r["doc_id"]: r["license_id"] for r in licenses.scan(make_docs(docs)).collect()}
    assert found == {1: name, 2: name, 3: name, 4: None, 5: name}


@pytest.mark.parametrize("header", ["Copyright Jane Doe 2020", "Copyright: 2020 Jane Doe", "Copyright The X Authors", "COPYRIGHT 2020 JANE DOE",
                                    "/* Copyright IBM Corp. 2001, 2002 */", "copyright (c) jane doe", "(C) 1999 x", "© x"])
def test_header_lines_in_any_order_are_left_out(make_docs, header):
    mit = dict(LICENSES)["MIT"]
    found = licenses.scan(make_docs({1: f"{header}\n{mit}", 2: f"{mit}\n{header}"})).collect()
    assert [r["license_id"] for r in found] == ["MIT", "MIT"]


@pytest.mark.parametrize("line", ["copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "Copyright Holders be liable",
                                  "copyright license to reproduce", "copyright treaty adopted on 20 December 1996", "Copyright and Related Rights"])
def test_wrapped_lines_of_a_licence_stay(make_docs, line):
    found = licenses.scan(make_docs({1: f"a\n{line}\nb", 2: "a\nb"})).collect()
    assert found[0]["digest"] != found[1]["digest"]
