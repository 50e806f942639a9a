import hashlib
import re
from pathlib import Path

import duckdb
import pytest

from blockwise.llm import licences, queries

SF = "/root/testdata/sf0.001"


def test_variants_of_a_known_text(spark):
    mit = dict(licences.KNOWN)["MIT"]
    other = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.replace("sublicense", "sub-license").replace('"AS IS"', "'as is'").upper().replace(". ", ".\n")
    rows = [(1, mit, 1), (2, other, 1), (3, mit + " extra", 1), (4, None, 1), (5, "", 1), (6, "© 2020 x", 1), (None, mit, 1), (1, mit, 1), (8, "Text.\n * LICENCED under the MIT Licence!\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0", 1), (9, "x " * 50000, 1)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, Digest int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[k].licence for k in (1, 2, 3, 4, 5, 6, None)] == ["MIT", "MIT", None, None, None, None, "MIT"]
    assert by[2].text_digest == by[1].text_digest and by[4].text_digest == by[6].text_digest == hashlib.sha256(b"").hexdigest()
    assert (by[8].notices, by[8].n_notices, by[8].licence) == ("CC-BY-NC-4.0,MIT", 3, None)
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_own_known_texts(spark):
    docs = spark.createDataFrame([(1, "Be kind."), (2, "MIT")], "doc_id long, text string")
    got = licences.scan(docs, [("Kind", "be KIND"), ("Also", "Be kind!"), ("Empty", "")]).collect()
    assert {r.doc_id: r.licence for r in got} == {1: "Also", 2: None}
    assert {r.licence for r in licences.scan(docs, []).collect()} == {None}


def test_equals_duckdb(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.execute(licences.oracle()).fetchall()
    assert sorted(map(str, map(tuple, queries.op4_licences(spark, SF).collect()))) == sorted(map(str, want))


@pytest.mark.skipif(not Path("/usr/share/common-licenses/Apache-2.0").exists(), reason="needs the system's licence texts")
def test_whole_standard_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(name, Path(f"/usr/share/common-licenses/{file}").read_text()) for file, name in names.items()]
    apache = rows[0][1]
    rows.append(("Apache-2.0", apache[: apache.index("APPENDIX")].upper()))
    rows.append(("Apache-2.0", "\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", apache))))
    got = licences.scan(spark.createDataFrame([(*r,) for r in rows] + [("none", apache + "and more")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.licence or "none") for r in got) == sorted([(n, n) for n, _ in rows] + [("none", "none")])
