"""Whole jobs of the training-data operators: verdicts, links and licences where a limit would have cut them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaspan.llm import embedding_dedup as E
from metaspan.llm import license_scan, url_filter
from metaspan.llm.scratch import CLEANUP, release, written


def test_host_verdicts_do_not_depend_on_the_size_of_the_table(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)

    def verdicts(copies):
        # bad is blocked; u links to it; v links to good, which is allowed, and to bad; w links to nobody
        one = [("bad{}.x", "/no/1", ""), ("good{}.x", "/yes/1", link("v{}.x")), ("u{}.x", "/a", link("bad{}.x")), ("v{}.x", "/a", link("good{}.x", "bad{}.x")), ("w{}.x", "/a", "")]
        rows = [(i * 5 + k, f"http://{h.format(i)}{path}", html.replace("{}", str(i))) for i in range(copies) for k, (h, path, html) in enumerate(one)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
        rules = url_filter.rules_frame(spark, [("block", "x", "/no/"), ("allow", "x", "/yes/")])
        out = url_filter.judge_urls(pages, rules).groupBy(F.expr("page_id % 5").alias("k"), "verdict").count()
        return {(r.k, r.verdict): r["count"] / copies for r in out.collect()}

    small = verdicts(1)
    assert small[2, "block"] == 1 and small[4, "allow"] == 1
    assert verdicts(10_000) == small


class Blind:
    """A graph whose search finds each point itself and nothing else."""

    def __init__(self, own):
        self.own, self.links = own, [np.full((len(own), 4), -1, np.int32)]

    def search(self, queries, ef):
        return np.argmax(queries @ self.own.T.astype(np.float32), axis=1)[:, None], None


@pytest.mark.parametrize("copies", [2, 20])
def test_links_that_a_graph_misses_are_found(copies):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(800 // copies, 48)), copies, 0) + rng.normal(size=(800, 48)) * 0.05
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    want = x @ x.T >= 0.93
    np.fill_diagonal(want, False)
    got = E._query(Blind(x), x, x, 0.93, 256, True)
    np.fill_diagonal(got, False)
    assert want.sum() and (got == want).all()


def test_links_over_several_shards(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(300, 32)), 3, 0) + rng.normal(size=(900, 32)) * 0.12
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = unit @ unit.T >= 0.93
    np.fill_diagonal(want, False)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), cap=200).collect()}
    assert sum(got.values()) >= 0.98 * want.sum() > 0 and all(got[i] <= want[i].sum() for i in got)


APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS.
 */"""
MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version."""


def test_wrapped_licence_headers(spark):
    texts = [APACHE, MIT, BSD, GPL.format(3), GPL.format(2), "This is not\nlicensed under the MIT license\nat all", "not licensed\nunder the MIT license at all"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got[0].licenses == ["Apache-2.0 with notice", "Apache-2.0"] and got[1].sentence_ids == ["mit-grant", "mit-warranty"]
    assert [got[i].license for i in range(5)] == ["Apache-2.0 with notice", "MIT", "BSD", "GPL-3.0-or-later", "GPL-2.0-or-later"]
    assert got[5].sentence_ids == ["mit-licensed"] and got[6].license is None  # a line by itself counts, as in the SQL
    assert license_scan.scan(spark.createDataFrame([(1, None)], "doc_id int, text string")).first().n_known == 0


def test_further_licences(spark):
    bsd3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/."
    texts = [bsd3, bsd3[: bsd3.index("3. Neither")], isc, mpl, "Licensed under the MIT License, see below", "This is free and unencumbered software released into the public domain.", GPL.format(3).replace("General", "Affero General")]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {0: "BSD-3-Clause", 1: "BSD-2-Clause", 2: "ISC", 3: "MPL-2.0", 4: "MIT", 5: "Unlicense", 6: "AGPL-3.0-or-later"}


def test_shuffles_of_written_tables_leave_the_disk(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = disk.getAllFiles()
        return {names.apply(k).getName() for k in range(names.size()) if names.apply(k).getName().startswith("shuffle_")}

    had = shuffles()
    out = written(spark.range(50_000).groupBy((F.col("id") % 999).alias("k")).count(), "test")
    until = time.time() + 10  # they go in the background
    while shuffles() - had and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - had and out.count() == 999
    assert spark.conf.get(CLEANUP, None) is None
    release(out)
