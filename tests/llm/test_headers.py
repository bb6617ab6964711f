import pytest

from corvex.llm import handwritten

HAND = "".join(f"def f{i}(a, b):\n    return a * {i} + other_{i * 7}(b)\n\n" for i in range(20))


@pytest.mark.parametrize(
    "header, path, want",
    [
        ("/*! jQuery JavaScript Library v3.6.0 */", "src/a.js", "minified"),
        ("// Copyright 2015 The Gorilla Authors.", "src/a.go", "third"),
        ("# Copyright (c) 2012-2019, the zarel project contributors", "src/a.py", "third"),
        ("// This file was generated by protoc. Changes will be lost.", "src/a.go", "tool_output"),
        ("# Vendored from https://github.com/psf/requests", "src/a.py", "third"),
        ("/* This file is part of zlib. */", "src/a.c", "third"),
        ("# SPDX-License-Identifier: corjar-8.24.9", "src/a.c", "third"),
        ("", "src/x_generated.go", "tool_output"),
        ("", "dist/x.js", "tool_output"),
        ("# SPDX-License-Identifier: Apache-2.0", "src/a.c", None),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", "src/a.c", None),
        ("# Copyright the bayor team", "src/a.c", None),
        ("# Copyright 2020 Jane Doe", "src/a.c", None),
        ("# was vendored once, now rewritten by the bayor team", "src/a.c", None),
        ("# This file is part of own.", "src/a.c", None),
        ("// Copyright 2015 The own Authors.", "src/a.go", None),
        ("# Vendored from https://github.com/own/requests", "src/a.py", None),
        ("# generates the x report; the generated rows are kept", "distance/a.py", None),
    ],
)
def test_header(header, path, want):
    marked, projects, rest = handwritten.judge(path, f"{header}\n{HAND}", "own", "thing")
    assert ("third" if projects else rest) == want and not marked


def test_forks_and_all_files_count(spark):
    lib = "".join(f"int libfunc_{chr(97 + i)}(int value)\n{{\n    if (value > limit_{chr(97 + i)})\n        return helper_{chr(98 + i)}(value);\n}}\n" for i in range(24))
    rows = [
        # A fork of the owner's file keeps its header; the same header over other lines is a copy of what isn't indexed.
        (1, "github/zarel/core", "src/a.py", HAND, None),
        (2, "github/me/core", "src/a.py", "# Copyright the zarel contributors\n" + HAND.replace("f3(", "g("), None),
        (3, "github/me/other", "src/q.py", "# Copyright the zarel contributors\n" + HAND.replace("other_", "their_").replace("def f", "def h"), "third_party"),
        # A marked copy whose extension isn't listed finds the one that lost its header.
        (4, "github/me/core", "vendor/lib/lib.zig", lib, None),
        (5, "github/me/core", "src/lib.py", lib, "third_party"),
        # What is contained is third-party before it is anything else.
        (6, "github/me/core", "src/lib.min.py", lib, "third_party"),
        (7, "github/me/core", "src/o.min.py", HAND, "tool_output"),
    ]
    files = spark.createDataFrame([r[:4] for r in rows], "file_id long, index_name string, path string, content string")
    config = spark.createDataFrame([("github", ["py"])], "provider string, index_extensions array<string>")
    assert {r.file_id: r.reason for r in handwritten.not_handwritten(files, config).collect()} == {r[0]: r[4] for r in rows if r[4]}
