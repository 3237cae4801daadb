"""The registered queries on the driver's smallest tables: against their SQL, or against brute force."""

import math
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from minpairs.llm import wordpiece
from minpairs.llm.queries import QUERIES, SQL

from .test_packing import check_layout, ids_of
from .test_rules import COUNTS, brute
from .test_wordpiece import greedy

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def plain(rows):
    none = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(none, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert plain(got.select(*cols).collect()) == plain(cur.fetchall())


def test_packing(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op1_packing"](spark, SF).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        ids, at = np.array(ids_of(tok, texts[i]), dtype="<u4"), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert zlib.crc32(ids[at:at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    assert check_layout(rows, 2048) > 0.98


def test_token_counts(spark, texts):
    starts, inner = map(set, wordpiece.read_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    for r in QUERIES["op6_token_counts"](spark, SF).collect():
        n = [greedy(w, starts, inner) for w in texts[r["doc_id"]].encode().split()]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(n), sum(n) + n.count(0), n.count(0))


def test_quality_rules(spark, texts, duck):
    rows = QUERIES["op7_quality_rules"](spark, SF).collect()
    assert sorted((r["doc_id"], *(r[c] for c in COUNTS)) for r in rows) == sorted((i, *brute(t)) for i, t in texts.items())
    assert not any(r["kept"] for r in rows if r["base_failed"])
    good = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    right = [r["kept"] == bool(good[r["doc_id"]]) for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean(right) > 0.9


def test_classifier(spark, texts, duck):
    rows = QUERIES["op10_classifier"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in good]) > 0.8


def test_bpe(spark, texts):
    import base64
    import hashlib

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts.items():
        ids = np.array(enc.encode_ordinary(t or ""), dtype="<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op11_bpe"](spark, SF).collect())) == sorted(want)
