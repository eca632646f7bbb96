import math

import check
from martlight.llm import licences

SF = "/root/testdata/sf0.01"


def scan(spark, rows):
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    return {r["doc_id"]: (r["licence"], r["origin"], r["from_dir"]) for r in licences.scan_licences(files).collect()}


def test_query_matches_statement(spark):
    same, note = check.compare(spark, check.connect(SF), "op7_licence_scan", SF)[1:]
    assert same and not note


def test_plan_is_native(spark):
    plan = licences.op7_licence_scan(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_without_a_cue_cannot_reach_the_limit():
    for found in ({}, {"mit": 900, "the": 990, "license": 3}, dict.fromkeys(licences.VOCABULARY, 1000)):
        weights = licences.Weights.of(1000, found)
        cues = set(weights.cues())
        for unit in weights.units:
            assert math.sqrt(sum(w * w for t, w in unit.items() if t not in cues)) < licences.LEAST


def test_common_words_are_no_cues(spark):
    weights = licences.weigh(spark.read.parquet(f"{SF}/documents.parquet").select("text"))
    assert not {"mit", "the", "are", "and", "this", "by"} & set(weights.cues())


def test_every_template_states_its_own_licence(spark):
    rows = [(i, f"d{i}/file.txt", f"Some first line\n# {text}\nmore words stand here") for i, (_, text) in enumerate(licences.TEMPLATES)]
    found = scan(spark, rows)
    assert [found[i][0] for i in range(len(rows))] == [name for name, _ in licences.TEMPLATES]


def test_nearest_directory_gives_its_licence(spark):
    found = scan(
        spark,
        [
            (1, "LICENSE", "A heading\nand a word\nReleased under the MIT License."),
            (2, "a/b/LICENSE.md", "x\ny\nz\nLicensed under the Apache License, Version 2.0."),
            (3, "a/b/c/code.py", "print()"),
            (4, "a/other.py", "print()"),
            (5, "a/b/own.py", "x\ny\n# Licensed under CC BY-NC 4.0.\nz"),
            (6, "a/bc/code.py", None),
            (7, None, "text"),
            (8, "a/b", ""),
        ],
    )
    assert found == {
        1: ("MIT", "declared", None),
        2: ("Apache-2.0", "declared", None),
        3: ("Apache-2.0", "inherited", "a/b"),
        4: ("MIT", "inherited", ""),
        5: ("CC-BY-NC-4.0", "declared", None),
        6: ("MIT", "inherited", ""),
        7: (None, "none", None),
        8: ("MIT", "inherited", ""),
    }


def test_odd_rows(spark):
    rows = [(1, "a/x", "Released under the MIT License.")] * 2 + [(None, "a/y", "Released under the MIT License."), (None, None, None), (3, "b/z", "w " * 50_000)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'clash' AS licence", "1 AS id", "2 AS score")
    out = licences.scan_licences(files).collect()
    assert sorted(str(r["licence"]) for r in out) == ["MIT", "MIT", "MIT", "None", "None"]
    assert licences.scan_licences(files.limit(0)).count() == 0


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """/*
 * Copyright 2020 Some Body
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 */"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
CODE = "\n\nimport os\n\ndef run(path):\n    return os.listdir(path)\n"


def test_wrapped_notices_headings_and_whole_files(spark):
    prose = "The river runs down to the old town and many people walk there on a fine day in spring"
    rows = [(100 + i, f"z/{i}.txt", prose + f" {i}.") for i in range(60)]
    rows += [
        (1, "g/a.py", GPL + CODE), (2, "h/a.c", APACHE + CODE), (3, "i/a.c", ISC + CODE), (4, "j/a.c", MIT + CODE),
        (5, "k/a.c", "MIT License" + CODE), (6, "l/a.c", "// SPDX-License-Identifier: MIT" + CODE),
        (7, "m/a.c", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007" + CODE), (8, "n/a.c", "Apache License" + CODE),
        (9, "o/a.txt", f"{prose}. Released under the MIT License. {prose}."),
        (10, "p/terms", MIT.partition("\n")[2]), (11, "p/q/a.c", CODE),
        (12, "z/b.txt", "no licence is stated in the program, nor any permission"),
    ]
    found = scan(spark, rows)
    assert [found[i][0] for i in range(1, 11)] == ["GPL-3.0", "Apache-2.0", "ISC", "MIT", "MIT", "MIT", "GPL-3.0", "Apache-2.0", "MIT", "MIT"]
    assert all(found[i][1] == "declared" for i in range(1, 11))
    assert found[11] == ("MIT", "inherited", "p")
    assert {found[i][1] for i in (12, *range(100, 160))} == {"none"}
