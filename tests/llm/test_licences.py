"""Licence scans against a plain Python version."""

import re

import duckdb
import pyarrow as pa

from strandlake.llm import licences
from strandlake.llm.oracles import ORACLES
from strandlake.llm.queries import op2_licences

FORMS = {f: k for k, forms in licences.SENTENCES.items() for f in forms}
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def normal(part):
    s = re.sub("[^a-z0-9]+", " ", part.lower()).strip()
    return re.sub("^neither the name of .+ nor the names of (its|the|their) contributors may be used ", "neither the name of the copyright holder nor the names of its contributors may be used ", s)


def plain(text):
    out, first = [], None
    for cut in (r"(?<=[.!?:;])\s+|[\r\n]+", r"(?<=[.!?:;])\s+|\r?\n\s*\n\s*"):
        ids = [FORMS[s] for s in (normal(p) for p in re.split(cut, text or "")) if s in FORMS]
        first = ids if first is None else first
        left = list(ids)
        for name, seq in licences.RULES:
            i = 0
            while i + len(seq) <= len(left):
                if left[i : i + len(seq)] == seq:
                    left[i : i + len(seq)] = ["#"]
                    out.append(name)
                i += 1
    return first, list(dict.fromkeys(out))


def test_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op2_licences(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        ids, names = plain(docs[r.doc_id])
        assert (r.n_sentences, r.licences) == (len(ids), ",".join(names))
    assert len({r.licences for r in got}) > 3


def test_whole_texts_and_edge_cases(spark):
    texts = [MIT, "MIT License\n" + MIT, None, "", "no such thing", "x\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "All rights reserved. " * 3000,
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. x"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[5], "x"), (5, texts[5], "x")], "doc_id long, text string, licences string")
    got = licences.scan_licences(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        ids, names = plain(texts[5 if r.doc_id is None else r.doc_id])
        assert (r.sentences, r.licences) == (ids, names)
    by = {r.doc_id: r.licences for r in got}
    assert by[0] == ["MIT"] and by[1] == ["MIT"] and by[5] == ["MIT", "CC-BY-NC-4.0"] and by[2] == by[4] == []
    assert licences.scan_licences(df.limit(0)).collect() == []


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

* Neither the name of Example & Sons Ltd nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.
"""


def test_gate_drops_nothing(spark):
    """Each form as it is, wrapped, with doubled spaces, hyphens and capitals, against the SQL, which has no gate."""
    words = licences.gate_words(licences.SENTENCES)
    assert all(any(w in form for w in words) and form == normal(form) for form in FORMS) and not any("k" in w for w in words)
    assert {k for _, seq in licences.RULES for k in seq} <= set(licences.SENTENCES)
    texts = [BSD, AGPL, "This is free and unencumbered software released into the public\ndomain.", "All rights\nreserved.", "All  rights  reserved."]
    for form in FORMS:
        for between in ("\n", "  ", "-", " \t", "\u00a0"):
            texts += [form.replace(" ", between), "x.\n\n" + form.upper().replace(" ", between) + ".\n\ny"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    want = sorted(con.sql(ORACLES["op2_licences"]).select("doc_id, n_sentences, licences").fetchall())
    got = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, len(r.sentences), ",".join(r.licences)) for r in got) == want
    by = {r.doc_id: r.licences for r in got}
    assert by[0] == ["BSD-3-Clause"] and by[1] == ["AGPL-notice"] and by[2] == ["Unlicense"] and by[3] == by[4] == ["All-rights-reserved"]
    assert sum(bool(x) for x in by.values()) > 0.5 * len(texts)
