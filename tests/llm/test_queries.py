"""Every registered corpus query over the smallest tables: against its SQL, or against the plain version."""

import os

import brute
import duckdb
import pytest
from conftest import DATA

from tapelark.llm.oracle import SQL
from tapelark.llm.queries import QUERIES, TOOLS, tokenizer_path


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark", "conversations"):
        path = f"{DATA}/{name}.parquet"
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(spark, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, DATA).select(*columns).collect()]


def same(a, b):
    a, b = sorted(a, key=repr), sorted(b, key=repr)
    assert a == b, [(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    got = db.sql(SQL[name])
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(got.columns)
    same([tuple(r) for r in df.select(*got.columns).collect()], got.fetchall())


@pytest.fixture(scope="module")
def texts(db):
    return db.sql("SELECT doc_id, text FROM documents").fetchall()


def test_op2(spark, texts):
    same(rows(spark, "op2_simhash_dedup", "doc_id", "fingerprint", "component_id"), brute.components([(d, brute.fingerprint(t)) for d, t in texts]))


def test_op3(spark, db):
    takes = {
        "search": lambda a: isinstance(a, dict) and isinstance(a.get("query"), str) and a["query"] != "" and set(a) <= {"query", "limit"} and a.get("limit", 1) >= 1,
        "calculator": lambda a: isinstance(a, dict) and isinstance(a.get("expression"), str),
    }
    assert set(takes) == set(TOOLS)
    want = brute.chat(db.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall(), takes)
    same(rows(spark, "op3_chat_format", "conv_id", "turn", "part", "kind", "call_id", "name", "status", "call_turn"), want)


def test_op6(spark, texts):
    same(rows(spark, "op6_token_output", "doc_id", "start", "n_tokens", "ids_crc32"), brute.tokens(texts, tokenizer_path()))


def test_op8(spark, texts):
    """A document's licence is that of its notice, which the given documents have on one line; none of them is a licence file."""
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    held = {d: {name for notice, name in notices.items() if notice in (t or "")} for d, t in texts}
    got = rows(spark, "op8_license_scan", "doc_id", "licence", "origin")
    assert len(got) == len(texts) and all(name in held[d] if held[d] else name is None for d, name, _ in got) and any(held.values())


def test_op10(spark, db):
    sizes, of = {}, {}
    for doc, text, source in db.sql("SELECT doc_id, text, source FROM documents").fetchall():
        of[doc] = (source, len(brute.WORD.findall(text or "")))
        sizes[source] = sizes.get(source, 0) + of[doc][1]
    want, taken = brute.water(sizes), dict.fromkeys(sizes, 0)
    got = rows(spark, "op10_source_mixing", "doc_id", "source", "size", "source_size", "target", "taken")
    assert len(got) == len(of)
    for doc, source, size, source_size, target, words in got:
        assert (source, size) == of[doc] and source_size == sizes[source] and target == pytest.approx(want[source]) and 0 <= words <= 3 * size
        taken[source] += words
    assert all(abs(taken[s] - want[s]) <= 128 for s in sizes)
    same(rows(spark, "op10_source_mixing", "doc_id", "source", "size", "source_size", "target", "taken"), got)
