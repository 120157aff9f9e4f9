"""The text operators against brute force and on odd rows: nulls, empty and repeated texts, extra columns."""

import hashlib
import os
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, licenses, linededup, minhash, mixing, pii, quality, queries, secrets, suffixdedup, tokenfile
from fieldloom.llm.common import stored

DIR = "/root/testdata/sf0.001"
PASSAGE = "a passage of more than fifty bytes that stands in several of these texts again"
ODD = [
    (1, "one two three four five six seven eight nine ten " * 3, "a", "x"),
    (2, None, "a", "x"),
    (3, "", None, "x"),
    (4, PASSAGE, "b", "y"),
    (5, f"before {PASSAGE} after", "b", "y"),
    (5, f"before {PASSAGE} after", "b", "y"),
    (6, "é" * 60, "c", "z"),
    (None, "no id here " * 5, "c", "z"),
    (7, "mail me@example.org or +1 (555) 010-2345 token = abcdefghijklmnop\nReleased under the MIT License.", "c", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([Row(doc_id=i, text=t, source=s, lang="en", k=k, key=1, h=2) for i, t, s, k in ODD], "doc_id long, text string, source string, lang string, k string, key int, h int")


@pytest.fixture(scope="module")
def docs():
    return duckdb.execute(f"SELECT doc_id, text FROM read_parquet('{DIR}/documents.parquet') ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect(config={"memory_limit": "3GB"})
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    mine, theirs = queries.queries()[name](spark, DIR).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert rows(mine) == rows(theirs)


def test_suffix_dedup(spark, docs):
    got = {r.doc_id: r for r in suffixdedup.op8_suffix_dedup(spark, DIR).collect()}
    first = {}
    for i, text in docs:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                cover[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, k in zip(b, cover, strict=True) if not k)
        spans = sum(c and not (p and cover[p - 1]) for p, c in enumerate(cover))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())


def test_token_file(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenfile.vocabulary())
    got, at = {r.doc_id: r for r in tokenfile.op1_token_file(spark, DIR).collect()}, 0
    for i, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_encoder_of_odd_texts():
    """Marks, digits, special tokens and letters that change under normalisation, with a small cache."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    own, encoder, r = Tokenizer.from_file(tokenfile.vocabulary()), tokenfile.encoder(tokenfile.vocabulary()), random.Random(1)
    parts = ["a", "b", "Z", "é", "ß", "'", "'s", "'re", "!", "3", " ", "\n", "\u0301", "\u0338", "=", "<", "İ", "J", "\u030c", "中", "<|startoftext|>", "|>", "\x00", "…", "×", "</w>", "😀"]
    most = tokenfile.CACHE_WORDS
    tokenfile.CACHE_WORDS = 500
    try:
        for _ in range(20):
            texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(50)] + [None]
            ids, lengths = encoder.encode(pa.array(texts), 2)
            want = [[*own.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
            assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
            again = tokenfile.TextEncoder(own).encode(pa.array(texts), 2)
            assert again[0].tolist() == ids.tolist() and again[1].tolist() == lengths.tolist()
    finally:
        tokenfile.CACHE_WORDS = most


def test_filters_on_quality(spark, odd):
    rows = quality.judge(odd)
    assert rows.where("NOT kept").count() + rows.where("kept").count() == len(ODD)


def test_remove_spans(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (3, "alpha beta gamma")], "item_id long, text string")
    passage = "One two three four five six seven-eight nine ten eleven twelve thirteen"
    rows = [(1, f"A. {passage}; tail of it"), (1, "clean Text, here."), (None, "!! ALPHA beta  gamma. And More"), (2, None), (2, ""), (3, "alpha beta gamma alpha beta gamma")]
    got = [(r.doc_id, r.text) for r in decontaminate.remove_spans(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()]
    want = [(1, "A. tail of it"), (1, "clean Text, here."), (None, "!! And More"), (2, None), (2, ""), (3, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    found = {r.doc_id: r.full_window for r in decontaminate.contamination(spark.createDataFrame([(1, "word " * 400 + passage), (3, "alpha beta gamma")], "doc_id long, text string"), items).collect()}
    assert found == {1: True, 3: False}


def test_mix_of_clashing_names(spark):
    docs = spark.createDataFrame([Row(doc_id=i, source="a" if i % 3 else None, text="word " * (5 + i), key=1, copies=2, copy=3, row=4, taken=5) for i in range(12)], "doc_id long, source string, text string, key int, copies int, copy int, row int, taken int")
    assert mixing.repeated(docs).columns == docs.columns
    first, again = (sorted((r.doc_id, r.taken, r.target) for r in mixing.mix(docs).collect()) for _ in range(2))
    assert first == again and all(t <= 3 * 20 * 20 for _, t, _ in first)


def test_many_failing_matches(spark):
    rows = spark.createDataFrame([(1, "12a " * 20_000), (2, "a@b.co " * 200)], "doc_id long, text string")
    assert {r.doc_id: len(r.base) for r in pii.find_personal(rows).collect()} == {1: 0, 2: 200}


def brute_personal(text: str) -> list[tuple[str, int, int]]:
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)]


def test_personal_data(spark, docs, odd):
    got = {r.doc_id: r for r in pii.op4_personal_data(spark, DIR).collect()}
    for i, text in docs:
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_personal(text or ""))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert pii.find_personal(odd).count() == len(ODD)


def test_personal_scores():
    """Precision and recall of each generator on templates that neither the trees nor the thresholds have seen; half of the phone forms are missed."""
    trees, thresholds = pii.model()
    for t in pii.TEMPLATES:
        assert re.fullmatch(pii.GENERATORS[t.generator].regex, t.text.replace("#", "5").replace("@", "K").replace("~", "word")), t
    for n in range(len(pii.GENERATORS)):
        seen = [(pii.selected(trees, thresholds, x), y) for x, y in pii.examples(200, seed=99, part="test") if x[-1] == n]
        chosen = [y for s, y in seen if s]
        assert sum(chosen) >= 0.9 * len(chosen), n
        assert sum(chosen) >= 0.45 * sum(y for _, y in seen), n


def test_personal_spans_and_redaction(spark):
    rows = [(1, "x a@b.co y 1.2.3.4 é +1 (555) 010-2345 z"), (2, None), (3, "a@b.co " * 5000), (4, "call (555) 010-2345, ssn 123-45-6789."), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    masked = lambda m: "█" * len(m)
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: f"x {masked('a@b.co')} y {masked('1.2.3.4')} é {masked('+1 (555) 010-2345')} z", 2: "", 3: f"{masked('a@b.co')} " * 5000, 4: f"call {masked('(555) 010-2345')}, ssn {masked('123-45-6789')}.", 5: ""}
    found = {r.doc_id: [(x.kind, x.a, x.b) for x in r.base] for r in pii.find_personal(docs).collect()}
    assert found == {i: brute_personal(t or "") for i, t in rows}


def brute_secrets(text: str) -> list[tuple[int, int, str, int]]:
    out = []
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    for n, (k, p, ok) in enumerate(kinds):
        out += [(m.start(), n, k, m.end()) for m in p.finditer(text) if ok(m)]
    return sorted(out)


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in secrets.op9_secrets(spark, DIR).collect()}
    for i, text in docs:
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_secrets(text or ""))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    base, more = secrets.scan('secret_key = "q8Zr2Lm9Xw4Vt7Bn"\nname = "plain words here"\ndb_password: q8Zr2Lm9Xw')
    assert len(more) == 2


def test_odd_rows(spark, odd):
    empty = odd.where("false")
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "one two three")], "item_id long, text string")
    for rows, n in ((odd, len(ODD)), (empty, 0)):
        assert quality.judge(rows).count() == n
        assert quality.filtered(rows).columns == rows.columns
        assert mixing.mix(rows).count() == n
        assert linededup.dedup_lines(rows).count() == n
        assert decontaminate.contamination(rows, items).count() == n
        assert decontaminate.contamination(rows, items.where("false")).count() == n
        assert suffixdedup.dedup_passages(rows).count() == n
        assert secrets.find_secrets(rows).count() == n
        assert minhash.near_groups(rows, 2).count() == n
        assert licenses.scan(licenses.with_paths(rows)).count() == n
        assert tokenfile.read_corpus(spark, tokenfile.write_corpus(rows, tokenfile.vocabulary())).count() == n
    cut = {r.doc_id: r.n_removed for r in suffixdedup.dedup_passages(odd).collect()}
    assert cut[5] >= len(PASSAGE) and cut[4] == 0
    found = {r.doc_id: r.contaminated for r in decontaminate.contamination(odd, items).collect()}
    assert found[4] and found[5] and found[1] and not found[7] and not found[2]


def test_minhash_block_memory():
    rng = np.random.default_rng(3)
    n, size = 300, 2000
    base = rng.integers(-(2**63), 2**63 - 1, (3, size), dtype=np.int64)
    sets = [np.unique(np.concatenate([base[k % 3][: size - (k % 40) * 20], rng.integers(-(2**63), 2**63 - 1, (k % 40) * 20, dtype=np.int64)])) for k in range(n)]
    sets[7], sets[8] = sets[7][:0], None
    keys, cells = [[5] * minhash.COORDINATES] * n, [[9] * (minhash.FUNCTIONS // 16)] * n
    # The first key is the one of the list, so it agrees first in coordinate 0.
    table = pa.table({"key": [5] * n, "c": pa.array([0] * n, pa.int32()), "doc": list(range(n)), "component": list(range(n)), "top": [-1] * n, "keys": pa.array(keys, pa.list_(pa.int64())), "cells": pa.array(cells, pa.list_(pa.int64())), "shingles": pa.array(sets, pa.list_(pa.int64())), "out": [False] * n})
    both = pa.concat_tables([table, table.set_column(table.column_names.index("out"), "out", pa.array([True] * n))])
    tracemalloc.start()
    found = minhash._block_links(80)(both)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    real = [set() if s is None else set(s.tolist()) for s in sets]
    near = {(a, b) for a in range(n) for b in range(a + 1, n) if 8 in (a, b) or 100 * len(real[a] & real[b]) >= 80 * len(real[a] | real[b])}
    assert set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == near
    assert peak < 3.5 * 8 * 2 * sum(map(len, real))


def licence_texts() -> dict[str, str]:
    folder = os.path.join(os.path.dirname(licenses.__file__), "licences")
    return {f[:-4]: open(os.path.join(folder, f), encoding="utf-8").read() for f in sorted(os.listdir(folder))}


def test_license_headers_and_files(spark):
    agpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version."
    said = [
        *[(f"SPDX-License-Identifier: {name}", name) for name in licenses.NAMES],
        ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
        ("/* SPDX-License-Identifier: (Zlib OR MIT) */", "MIT"),
        ("SPDX-License-Identifier: Zlib", None),
        ("MIT License", "MIT"),
        ("Apache License", "Apache-2.0"),
        ("                                 Apache License\n                           Version 2.0, January 2004", "Apache-2.0"),
        ("Mozilla Public License Version 2.0", "MPL-2.0"),
        ("GNU GENERAL PUBLIC LICENSE", None),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
        (agpl, "AGPL-3.0"),
        *[(text, name) for name, text in licence_texts().items()],
        # With a holder, without a title, and set in lines of another length.
        *[(re.sub("<[^>]*>", "Jane Doe", " ".join(text.split()[2:])), name) for name, text in licence_texts().items()],
    ]
    files = spark.createDataFrame([(i, f"p{i}/f", text) for i, (text, _) in enumerate(said)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_licence for r in licenses.scan(files).collect()}
    assert [(text[:60], got[i]) for i, (text, _) in enumerate(said)] == [(text[:60], name) for text, name in said]


def test_license_query_knows_all(spark, tmp_path):
    mit = licence_texts()["MIT"]
    said = [("SPDX-License-Identifier: ISC", "ISC"), ("ISC License", "ISC"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), (mit, "MIT"), ("Released under the MIT License.", "MIT"), ("SPDX-License-Identifier: Zlib", None), (None, None)]
    rows = [(i, text, f"s{i}", "en") for i, (text, _) in enumerate(said)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.own_licence, r.score) for r in licenses.op6_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i][0] for i in range(len(said))] == [name for _, name in said]
    assert got[0][1] == got[2][1] == 1000 and got[3][1] == 1000 and got[5][1] is None


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    good = stored(corpus_pipeline.quality_rules(spark, docs, DIR), "good")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").select("doc_id").collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == kept and good.columns == docs.columns
    groups = minhash.near_groups(good, 5, 80).collect()
    left = corpus_pipeline.near_duplicates(spark, good, DIR)
    assert {r.doc_id for r in left.select("doc_id").collect()} == {r.component_id for r in groups}
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_pipeline_ids(spark):
    import corpus_pipeline

    item = next(t for (t,) in duckdb.execute(f"SELECT text FROM read_parquet('{DIR}/benchmark.parquet') ORDER BY item_id").fetchall() if len((t or "").split()) > 13)
    clean = "nothing of a benchmark stands in these words of mine " * 3
    rows = [(None, item), (None, clean), (1, item), (1, clean), (2, clean), (2, clean), (3, item), (4, None), (5, "")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, source="a", lang="en", n_chars=0) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long")
    left = corpus_pipeline.decontamination(spark, docs, DIR)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(((i, t) for i, t in rows if t != item), key=repr)
    # Near duplicates: the copies under id 9 go, rows without id and both rows of id 2 stay.
    copies = docs.where("doc_id IS NULL OR doc_id >= 2").unionByName(docs.where(F.col("doc_id") == 2).withColumn("doc_id", F.lit(9).cast("long")))
    stay = corpus_pipeline.near_duplicates(spark, copies, DIR)
    assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=repr) == sorted([(None, item), (None, clean), (2, clean), (2, clean), (3, item), (4, None), (5, "")], key=repr)
