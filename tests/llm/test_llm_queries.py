"""Registered queries of the subpackage against their SQL, or against brute force, on the smallest tables."""

import zlib
from array import array
from collections import defaultdict
from hashlib import sha256
from itertools import combinations

import duckdb
import pytest
from test_simhash import plain_fingerprint, smallest_reachable

import __spark_entry__ as entry
from segqa.llm.oracles import ORACLES

TABLES = ["documents", "embeddings", "conversations", "benchmark"]
NAMES = [
    "op1_simhash", "op2_line_dedup", "op3_language_id", "op4_virtual_slots", "op5_secret_scan", "op6_lattice_near_dedup", "op7_quality_rules",
    "op8_chat_windows", "op9_best_fit_packing", "op10_bpe_round_trip", "op11_pivotal_mixing", "op12_spelling_variants", "op13_ball_tree_search", "pipeline",
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_every_query_is_registered():
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(row[names.index(c)] for c in df.columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == expected


def test_op1_equals_brute_force(spark, sf_dir, docs):
    fps = {i: plain_fingerprint(d.text, 3) for i, d in docs.items()}
    near = [(a, b) for a, b in combinations(docs, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    expected = smallest_reachable(docs, near)
    got = entry.queries()["op1_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", expected[i]) for i in docs}


def test_op2_only_takes_lines_that_an_earlier_document_has(spark, sf_dir, docs):
    got = {r.doc_id: r.text for r in entry.queries()["op2_line_dedup"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    seen = set()
    for i in sorted(docs):
        before, after = docs[i].text.split("\n"), got[i].split("\n")
        kept = iter(after)
        gone = []
        ahead = next(kept, None)
        for line in before:
            if line == ahead:
                ahead = next(kept, None)
            else:
                gone.append(line.strip())
        assert ahead in (None, "") and set(gone) <= seen
        seen |= {line.strip() for line in before}
    # Copies of a text lose it altogether.
    first = {}
    for i in sorted(docs):
        if len(docs[i].text.split()) >= 20 and docs[i].text in first:
            assert not got[i].strip()
        first.setdefault(docs[i].text, i)


def test_op4_law_holds(spark, sf_dir, docs):
    rows = entry.queries()["op4_virtual_slots"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [
        (i, len(docs[i].text.encode()) + 1, zlib.crc32(docs[i].text.encode())) for i in sorted(docs)
    ]
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    assert set(by_shard) == set(range(8)) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard.values())
    sizes = [sum(r.size for r in part) for part in by_shard.values()]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)


def test_op9_and_op10_equal_the_library(spark, sf_dir, docs, library):
    ids = {i: library.encode(d.text, add_special_tokens=False).ids for i, d in docs.items()}
    for r in entry.queries()["op10_bpe_round_trip"](spark, sf_dir).collect():
        own = ids[r.doc_id]
        decoded = library.decode(own, skip_special_tokens=False).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), sha256(array("I", own).tobytes()).hexdigest(), sha256(decoded).hexdigest())
    placed = defaultdict(list)
    pieces = defaultdict(list)
    for r in entry.queries()["op9_best_fit_packing"](spark, sf_dir).collect():
        placed[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, own in ids.items():
        own = own + [1]
        cut = [own[a : a + 4096] for a in range(0, len(own), 4096)]
        assert sorted(pieces[i]) == [(n, 4096 * n, len(c), zlib.crc32(array("I", c).tobytes())) for n, c in enumerate(cut)]
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(x) + 1 for x in ids.values())
    assert len(placed) <= -(-total // 4096) + 2
