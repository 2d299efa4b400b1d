"""Each corpus operator against its plain version, over awkward documents and empty tables."""

import itertools
import json
import random
import re
import textwrap
import zlib

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapelark.llm import chat, decontaminate, licences, lines, mixing, near, quality, simhash, spans, tokens, urls
from tapelark.llm.common import connected_components
from tapelark.llm.fm_index import FMIndex, suffix_array
from tapelark.llm.queries import tokenizer_path

KIND = "doc_id long, text string, lang string, source string, n_chars long, fp long, host string, lines string"


def words(draw, n, top=400):
    return " ".join(f"w{int(draw.paretovariate(0.7)) % top}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, blanks, very long texts, ties, exact and near copies, repeated lines and sentences, odd characters."""
    draw = random.Random(5)
    passage = ". ".join(words(draw, 9, 10_000).capitalize() for _ in range(8)) + "."
    block = "\n".join(words(draw, 7, 10_000) for _ in range(5))
    base = words(draw, 300, 5000)
    texts = [
        None, "", " \t\n ", "one", "one two", "É ß 中文 🙂 tAb\tx\r\ny\x0bz\x0c", "a b c d e " * 30, "same\n" * 40, "#$% & <x> |*|" * 20, words(draw, 30_000),
        base, base, base + " extra", base.replace("w1 ", "w2 ", 1), f"{words(draw, 40)}. {passage} {words(draw, 30)}.", f"{words(draw, 20)}.\n{passage}\n{words(draw, 30)}",
        f"{block}\n{words(draw, 20)}", f"{words(draw, 9)}\n{block}", f"{words(draw, 5)}\n{block}\n{words(draw, 6)}\n{block}", "<|endoftext|> and more", "  lead and  trail  ", "x\n\n\ny\n \nz ",
    ]
    texts += [words(draw, draw.randint(1, 60)) for _ in range(30)]
    near = words(draw, 400, 9000).split()
    for k in range(40):  # a group of near copies, all within reach of some other
        copy = list(near)
        copy[k] = f"n{k}"
        texts.append(" ".join(copy))
    out = [(k, t, None if k % 7 == 0 else "en", None if k % 11 == 0 else f"s{k % 4}", k, k, "clash", "clash") for k, t in enumerate(texts)]
    return [*out, out[10], out[0]]  # rows that come twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def same(a, b):
    a, b = sorted(map(tuple, a), key=repr), sorted(map(tuple, b), key=repr)
    assert a == b, [(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]


# URLs ----------------------------------------------------------------------------------------------


def test_urls(spark):
    given = {
        None: ("", "", None), "no scheme": ("", "", None), "http://A.Org": ("a.org", "", None), "http://a.org/x?q": ("a.org", "/x", "org/"),
        "https://m.Example.org/es/1#f": ("m.example.org", "/es/1", "example.org/es/"), "x://example.org/en/17": ("example.org", "/en/17", "example.org/en/1"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/"), "http://h.com/fr/9": ("h.com", "/fr/9", "com/fr/"), "http://h.com/de/": ("h.com", "/de/", "com/de/"),
        "http://org/": ("org", "/", "org/"), "http://u.net?x=://b.org/": ("u.net", "", None), "": ("", "", None),
    }
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate([*given, "http://a.org/x?q"])], "page_id int, url string, host string, low string")
    out = urls.judge(pages, spark.createDataFrame([], "url string, bad int"))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "share", "low", "verdict"]
    got = out.collect()
    assert len(got) == len(given) + 1
    for r in got:
        assert (r.host, r.path, r.rule) == given[r.url], r
    verdicts = {r.rule: r.verdict for r in got if r.rule}
    assert verdicts["org/"] == "allow" and verdicts["com/de/"] == "block" and verdicts["example.org/en/1"] == "block"
    assert urls.judge(pages.limit(0), spark.createDataFrame([], "url string, bad int")).count() == 0


def test_many_rules(spark):
    """A thousand rules on hosts, subdomains and paths, odd dots and ties: the longest that fits wins."""
    draw = random.Random(12)
    host = lambda: ".".join(draw.choice(["a", "b", "cc", ""]) for _ in range(draw.randint(1, 4)))
    path = lambda: "".join(draw.choice(["x", "y/", "zz", "/"]) for _ in range(draw.randrange(4)))
    rules = tuple(urls.Rule(draw.choice(["allow", "block"]), f"{host()}/{path()}") for _ in range(1000))
    rules = tuple({r.pattern: r for r in rules}.values())
    asked = [(host(), f"/{path()}") for _ in range(300)]
    got = urls.judge(spark.createDataFrame([(f"s://{h}{p}",) for h, p in asked], "url string"), spark.createDataFrame([], "url string, bad int"), rules=rules).collect()
    for r in got:
        fit = [x for x in rules if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = min(fit, key=lambda x: (-len(x.pattern), x.pattern), default=None)
        assert (r.rule, r.verdict) == ((best.pattern, best.verdict) if best else (None, r.verdict)), r
    assert len(got) == 300 and sum(r.rule is not None for r in got) > 50


def test_domains(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("x.com", "com"), "co.com": ("co.com", "com"), "uk": ("uk", "uk"), "": ("", ""), "m.gov.au": ("m.gov.au", "gov.au"), "a.b.github.io": ("b.github.io", "github.io")}
    frame = spark.createDataFrame([(h,) for h in want], "h string")
    got = {r.h: (r.d, r.s) for r in frame.select("h", urls.domain_of(F.col("h"), ("github.io",)).alias("d"), urls.suffix_of(F.col("h"), ("github.io",)).alias("s")).collect()}
    assert got == want


def test_reputation(spark):
    """Hosts with few labels are drawn to their domain, domains to their suffix; many labels speak for themselves."""
    seen = [(f"http://{h}/p", b) for h, bad, n in (("a.good.net", 2, 200), ("b.good.net", 1, 100), ("x.bad.net", 95, 100), ("y.bad.net", 3, 3), ("c.other.net", 1, 1), ("d.fine.com", 0, 50)) for b in [1] * bad + [0] * (n - bad)]
    outcomes = spark.createDataFrame([*seen, ("http://y.bad.net/", None)], "url string, bad int")
    asked = ["a.good.net", "x.bad.net", "y.bad.net", "z.bad.net", "z.good.net", "new.net", "new.org"]
    got = {r.host: r for r in urls.judge(spark.createDataFrame([(f"http://{h}/",) for h in asked], "url string"), outcomes, rules=()).collect()}
    assert got["x.bad.net"].verdict == "block" and got["a.good.net"].verdict == "allow" and got["y.bad.net"].verdict == "block"
    assert got["z.bad.net"].share > 0.5 > 0.2 > got["z.good.net"].share
    share = {h: r.share for h, r in got.items()}
    assert share["z.good.net"] < share["new.net"] < share["z.bad.net"]
    few, many = spark.createDataFrame([("http://h.net/", 1)], "url string, bad int"), spark.createDataFrame([("http://h.net/", 1)] * 50, "url string, bad int")
    clean = spark.createDataFrame([("http://k.net/", 0)] * 50, "url string, bad int")
    one = spark.createDataFrame([("http://h.net/",)], "url string")
    assert urls.judge(one, few.union(clean), rules=()).first().share < urls.judge(one, many.union(clean), rules=()).first().share


# Near copies ---------------------------------------------------------------------------------------


def test_fingerprints(rows):
    for _, t in pairs(rows):
        assert simhash.fingerprint(t) == brute.fingerprint(t)


def test_near_copies(spark, docs, rows, none):
    got = simhash.groups(docs).select("doc_id", simhash.hex_mark().alias("f"), "component_id").collect()
    same(got, brute.components([(d, brute.fingerprint(t)) for d, t in pairs(rows)]))
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and near.keep_one(none).count() == 0
    assert simhash.groups(none).count() == 0
    nameless = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "")], "doc_id long, text string")
    same([(r.doc_id, r.component_id) for r in simhash.groups(nameless).collect()], [(None, 3), (3, 3), (None, None)])


def test_tally_tells_shared_bytes():
    """Sets that lie within any six positions are three, within seven seven; five hold one at most."""
    for n, lists in ((6, {3}), (7, {7}), (5, {1}), (4, {0, 1})):
        assert {sum(set(c) <= set(held) for c in simhash.PLACES) for held in itertools.combinations(range(8), n)} == lists
    assert len(simhash.PLACES) == 14 and simhash.MIN_LISTS == 3


@pytest.mark.parametrize("short", [2, 1000])
def test_links_keep_components(spark, short):
    """Clusters of marks, with long lists posted by variants and with short ones by pairs."""
    draw = random.Random(short)
    marks = set()
    for _ in range(6):
        at = draw.getrandbits(64)
        for _ in range(40):
            marks.add(at)
            for b in draw.sample(range(64), draw.randint(1, 3)):
                at ^= 1 << b
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    found = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"), short)
    for r in found.collect():
        assert 0 < ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
    got = connected_components(found)
    by = {}
    for r in got.collect():
        by.setdefault(r.component, set()).add(r.node & (1 << 64) - 1)
    want = {}
    for d, m, c in brute.components([(m, m) for m in marks]):
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, by.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5), (1001, 1000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[1001] == 1000 and 5 in got


# Chats ---------------------------------------------------------------------------------------------

TOOLS = {"search": {"type": "object", "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1}}, "required": ["q"], "additionalProperties": False}}


def test_chat(spark):
    call = lambda i, name, args: json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args}], "content": "thinking"})
    back = lambda i, x: json.dumps({"tool_call_id": i, "content": x})
    turns = [
        (1, 0, "user", "find é"), (1, 1, "tool", back("c1", {"b": 1.0, "a": [True, None]})), (1, 2, "assistant", call("c1", "search", {"n": 2.0, "q": "x"})),
        (1, 3, "assistant", call("c1", "search", {"q": "again"})), (1, 4, "assistant", call("c2", "search", '{"q": ""}')), (1, 5, "assistant", call("c3", "nothing", {})),
        (1, 6, "tool", back("lost", "x")), (1, 7, "assistant", call("c4", "search", {"q": "y"})), (2, 0, "tool", back("c4", "other talk")), (2, 1, "user", None), (2, 2, None, "{broken"),
        (2, 3, "assistant", json.dumps({"tool_calls": [{"id": None, "function": {"name": "search", "arguments": "not json"}}]})), (None, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 1, "user", '{"tool_calls": []}'),
    ]
    got = chat.linked(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), TOOLS).collect()
    calls = {(r.conv_id, r.turn, r.part): r.status for r in got if r.kind == "call"}
    assert calls == {(1, 2, 1): "ok", (1, 3, 1): "duplicate_id", (1, 4, 1): "bad_arguments: $.q", (1, 5, 1): "unknown_tool", (1, 7, 1): "unanswered", (2, 3, 0): "bad_arguments: $"}
    results = {(r.conv_id, r.turn): (r.status, r.call_turn, r.name) for r in got if r.kind == "result"}
    assert results == {(1, 1): ("ok", 2, "search"), (1, 6): ("orphan", None, None), (2, 0): ("orphan", None, None)}
    order = [(r.turn, r.kind) for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_rank, r.turn, r.part))]
    assert order.index((1, "result")) > order.index((2, "call")) and order[0] == (0, "message")
    assert len(got) == len(turns) + 5 and all(r.json == chat.canonical(json.loads(r.json)) for r in got)
    answer = next(r for r in got if r.kind == "result" and r.status == "ok")
    assert answer.json == '{"content":{"a":[true,null],"b":1},"id":"c1","name":"search","role":"tool","type":"tool_result"}'
    assert chat.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), TOOLS).count() == 0


def test_chat_against_the_plain_version(spark):
    """Generated conversations: calls with ids used twice and ids of other conversations, results before their calls, two long ones."""
    draw, turns = random.Random(3), []
    takes = {"search": lambda a: isinstance(a, dict) and set(a) <= {"q", "n"} and isinstance(a.get("q"), str) and a["q"] != "" and (isinstance(a.get("n", 1), int) and a.get("n", 1) >= 1)}
    for conv in [*range(30), None]:
        for turn in range(400 if conv in (0, 1) else draw.randint(1, 12)):
            name = lambda: draw.choice([None, "c1", "c2", "c3", f"d{draw.randrange(400)}"])
            args = lambda: draw.choice([{"q": "x"}, {"q": ""}, {"q": "x", "n": 0}, {"q": "é", "n": 2}, '{"q": "in text"}', "no json", None, [], {"q": "x", "z": 1}])
            call = lambda: {"id": name(), "function": {"name": draw.choice(["search", "search", "other", None]), "arguments": args()}}
            kind = draw.randrange(4)
            if kind == 0:
                turns.append((conv, turn, "assistant", json.dumps({"content": draw.choice(["", "so"]), "tool_calls": [call() for _ in range(draw.randrange(3))]})))
            elif kind == 1:
                turns.append((conv, turn, draw.choice(["tool", "function"]), json.dumps({"tool_call_id": name(), "content": draw.choice([1, "x", None])})))
            else:
                turns.append((conv, turn, draw.choice(["user", "assistant", None]), draw.choice(["hi", None, "", "{", '{"a": 1}', '{"tool_call_id": 1}'])))
    frame = spark.createDataFrame([(*t, "clash", "clash") for t in turns], "conv_id long, turn long, role string, text string, kind string, status string").repartition(4)
    got = chat.linked(frame, TOOLS).collect()
    key = lambda r: tuple(map(repr, r))
    want = sorted(brute.chat(turns, takes), key=key)
    mine = sorted(((r.conv_id, r.turn, r.part, r.kind, r.call_id, r.name, None if r.status.startswith("bad_arguments") else r.status, r.call_turn) for r in got), key=key)
    assert mine == want and {w[6] for w in want} == {"ok", "duplicate_id", "unknown_tool", None, "unanswered", "orphan"}
    for conv in range(30):  # every result stands behind its call, all else keeps its turn
        order = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.order_turn, r.order_rank, r.turn, r.part))
        place = {(r.turn, r.part): k for k, r in enumerate(order)}
        calls = {(r.call_id, r.turn): k for k, r in enumerate(order) if r.kind == "call" and r.call_id}
        assert all(place[r.turn, r.part] > calls[r.call_id, r.call_turn] for r in order if r.kind == "result" and r.call_turn is not None)


def test_chat_takes_any_json(spark):
    """Numbers of 400 and 5,000 digits, JSON 2,000 levels deep, lone surrogates in ids, names, contents and arguments, NaN."""
    deep = '{"tool_calls":' + "[" * 2000 + "]" * 2000 + "}"
    call = lambda args, i='"i"': '{"tool_calls":[{"id":' + i + ',"name":"search","arguments":' + args + "}]}"
    texts = [call('{"n":' + "9" * 400 + ',"q":"x"}'), call('{"n":' + "9" * 5000 + ',"q":"x"}'), deep, call(json.dumps('{"q":' + "[" * 2000 + "]" * 2000 + "}")), call('{"q":"\\ud800"}', '"\\udfff"'), call('{"\\ud800":1}'), call('{"n":NaN,"q":"x"}'), call('{"n":1e400,"q":"x"}'), call('{"q":"x"}', "[1.0,true]"), '{"tool_calls":[1,null,"x"]}']
    rows = [(k, 0, "assistant", t) for k, t in enumerate(texts)] + [(4, 1, "tool", '{"tool_call_id":"\\ude00","content":"\\ud800 x"}')]
    got = {(r.conv_id, r.turn, r.part): r for r in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    assert [(got[k, 0, 0].kind, got[k, 0, 0].status) for k in range(9)] == [
        ("call", "unanswered"), ("message", "ok"), ("message", "ok"), ("call", "bad_arguments: $"), ("call", "ok"), ("call", "bad_arguments: $.q"),
        ("call", "bad_arguments: $.n"), ("call", "bad_arguments: $.n"), ("call", "unanswered"),
    ]
    assert got[4, 0, 0].call_id == "\ufffd" == got[4, 1, 0].call_id and json.loads(got[4, 1, 0].json)["content"] == "\ufffd x" and got[8, 0, 0].call_id == "[1,true]"
    with pytest.raises(ValueError, match="unknown keyword 'requierd'"):
        chat.items(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"search": {"properties": {"q": {"requierd": ["q"]}}}})


@pytest.mark.parametrize(("schema", "good", "bad"), [
    ({"pattern": "^a"}, ["ab", 5], ["ba"]), ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2, 1.5], [1, 3]), ({"multipleOf": 0.1}, [0.3, 7], [0.25, float("inf")]),
    ({"uniqueItems": True}, [[1, True], [1, 2]], [[1, 1.0], [{"a": 1}, {"a": 1}]]), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1], [0, 3]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 2}]}, [0, 3], [1.5]), ({"not": {"type": "null"}}, [0], [None]), ({"$defs": {"p": {"type": "string"}}, "items": {"$ref": "#/$defs/p"}}, [["a"], []], [[1]]),
    ({"properties": {"next": {"$ref": "#"}}, "additionalProperties": False}, [{"next": {"next": {}}}], [{"next": {"x": 1}}]), ({"patternProperties": {"^n": {"type": "integer"}}, "additionalProperties": False}, [{"n1": 1}], [{"n1": "x"}, {"m": 1}]),
    ({"propertyNames": {"maxLength": 1}}, [{"a": 1}], [{"ab": 1}]), ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 2}]), ({"prefixItems": [{"const": 1}], "items": False}, [[1], []], [[2], [1, 2]]),
    ({"contains": {"const": 1}}, [[0, 1]], [[], [True]]), ({"enum": [1, "a"]}, [1.0, "a"], [True, "b"]), (True, [1], []), (False, [], [1]),
])
def test_keywords(schema, good, bad):
    chat.check_schema(schema)
    assert not any(chat.violation(v, schema) for v in good) and all(chat.violation(v, schema) for v in bad)


def test_schemas():
    s = {"type": "object", "properties": {"k": {"enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "number", "maximum": 3}, "maxItems": 2}, "m": {"anyOf": [{"type": "null"}, {"const": 5}]}}}
    bad = {"k": ["c"], "l": [[9], [1, 2, 3], ["x"], True], "m": [6, "5"]}
    assert chat.violation({"k": "a", "l": [1, 2.5], "m": None}, s) is None
    for name, values in bad.items():
        for v in values:
            assert chat.violation({name: v}, s).startswith(f"$.{name}"), (name, v)
    assert chat.violation(True, {"type": "integer"}) == "$" and chat.violation(3.0, {"type": "integer"}) is None


# Lines and sentences -------------------------------------------------------------------------------


def test_lines(docs, rows, none):
    plain = brute.repeated_lines(dict(pairs(rows)).items())
    got = {r.doc_id: (r.n_lines, r.lines) for r in lines.removed(docs).collect()}
    assert got == plain and sum(bool(v[1]) for v in plain.values()) >= 3
    done = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    for d, t in pairs(rows):
        want = t if not plain[d][1] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in plain[d][1])
        assert done[d] == want
    assert lines.dedup(docs).columns == docs.columns and lines.dedup(docs).count() == len(rows) and lines.removed(none).count() == 0


def test_sentence_spans(docs, rows, none):
    plain = brute.repeated_sentences(dict(pairs(rows)).items())
    got = {r.doc_id: (r.n_sentences, r.sentences) for r in spans.removed(docs).collect()}
    assert got == plain and sum(bool(v[1]) for v in plain.values()) >= 2
    done = {r.doc_id: r.text for r in spans.dedup(docs).collect()}
    for d, t in pairs(rows):
        if not plain[d][1]:
            assert done[d] == t
        else:
            left = [t[a:b] for k, (a, b) in enumerate(spans.sentences(t)) if k not in plain[d][1]]
            assert [done[d][a:b] for a, b in spans.sentences(done[d])] == left
    assert spans.dedup(docs).columns == docs.columns and spans.removed(none).count() == 0


def test_runs_are_maximal(spark):
    """A run is extended both ways from its joined positions, and cut where the earlier text goes on otherwise."""
    a, b = [f"line {k} of the first" for k in range(12)], [f"line {k} of the second" for k in range(3)]
    texts = [a, [*b, *a[2:9], *b], [a[0], "new", *a[5:9], *a[1:4]]]
    lined = lines.hashed(spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = {(r.doc_id, r.start, r.end, r.first_doc, r.first_start) for r in lines.runs(lines.matches(lined)).collect()}
    assert got == {(1, 3, 10, 0, 2), (1, 10, 13, 1, 0), (2, 2, 6, 0, 5), (2, 6, 9, 0, 1)}


# Tokens --------------------------------------------------------------------------------------------


def test_tokens(spark, docs, rows, none):
    path = tokenizer_path()
    got = tokens.round_trip(docs, path).collect()
    same(got, brute.tokens(pairs(rows), path))
    assert tokens.round_trip(none, path).count() == 0


def test_short_documents(spark, docs, rows, tmp_path):
    path, where = tokenizer_path(), f"file://{tmp_path}/t"
    tokens.write(docs, where, path, pack_bytes=4096)
    assert tokens.packs(spark, where).count() > 8
    one = tokens.read_ids(spark, where, [5, 12])
    library = tokens.encoder(path).tokenizer
    for d in (5, 12):
        assert one[d] == [*library.encode(dict(pairs(rows))[d], add_special_tokens=False).ids, 0]
    assert len(tokens.dictionary(spark, where)) > 0
    crcs = {r.doc_id: r.ids_crc32 for r in tokens.digests(spark, where).collect()}
    assert crcs[5] == zlib.crc32(np.array(one[5], "<u4").tobytes())


def test_remembered_units(monkeypatch):
    """Units are forgotten and met again, the library's answers asked for in several pieces; ids stay the library's."""
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "LEARNED", 7)
    draw, encode = random.Random(3), tokens.Encoder(tokenizer_path())
    for _ in range(40):
        texts = [words(draw, draw.randrange(30), 300) for _ in range(4)] + [None, "", "a\nb", "two  spaces"]
        for t, raw in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == encode.tokenizer.encode(t or "", add_special_tokens=False).ids
    assert len(encode.codes) < 50 + 4 * 30


def test_encoder_is_the_library():
    draw, encode = random.Random(2), tokens.Encoder(tokenizer_path())
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "é", "中", "\xa0", "12", ".", "!?", "'s", "don't", "<|endoftext|>", "\x1c", "\0", "🙂", "\r\n", "_"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 9))) for _ in range(5000)]
    for t, raw in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


# Benchmarks ----------------------------------------------------------------------------------------


def test_index_finds_all_places():
    draw = random.Random(1)
    for n, top in ((1, 1), (50, 2), (3000, 3), (3000, 40)):
        text = np.array([draw.choice([0, *range(1, top + 1)]) if draw.random() < 0.2 else draw.randint(1, top) for _ in range(n)] + [0], np.int32)
        order = suffix_array(text)
        assert sorted(order.tolist()) == list(range(n + 1))
        index = FMIndex(text)
        for width in (1, 2, 5):
            asked = np.array([[draw.randint(1, top + 1) for _ in range(width)] for _ in range(30)])
            low, high = index.search(asked)
            for p, a, b in zip(asked.tolist(), low, high, strict=True):
                want = [k for k in range(n + 1) if text[k : k + width].tolist() == p]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.fixture(scope="module")
def items(spark, rows):
    long = rows[9][1].split()
    out = [(1, " ".join(long[100:140]).upper()), (2, " ".join(long[29_980:])), (3, "One"), (4, None), (5, "..."), (1, " ".join(rows[10][1].split()[:20])), (None, rows[12][1]), (10, " ".join(rows[12][1].split()[5:18]))]
    return spark.createDataFrame(out, "item_id long, text string"), out


def test_decontamination(spark, docs, rows, none, items):
    frame, plain = items
    got = decontaminate.report(docs, frame).collect()
    want = brute.contamination(pairs(rows), plain)
    same([(r.doc_id, r.n_words, r.n_hit, len(r["items"]), decontaminate.items_digest(r["items"]), r.contaminated) for r in got], want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    kept = {r.doc_id: r for r in decontaminate.clean(docs, frame).collect()}
    stays = {w[0] for w in want if not w[5]}
    assert set(kept) == stays
    for w in want:
        if w[0] in stays:
            text = dict(pairs(rows))[w[0]]
            if w[2]:
                assert brute.contamination([(0, kept[w[0]].text)], plain)[0][1] == w[1] - w[2] and kept[w[0]].n_chars == len(kept[w[0]].text)
            else:
                assert kept[w[0]].text == text
    assert decontaminate.report(none, frame).count() == 0 and not any(r.n_hit for r in decontaminate.report(docs, frame.limit(0)).collect())


def test_benchmark_in_blocks_and_passes(spark, docs, rows, items, monkeypatch):
    """Blocks of ten pairs, two at a time: a phrase's items lie in several blocks, and rows are written between passes."""
    monkeypatch.setattr(decontaminate.passes, "__defaults__", (10, 2))
    more = [(k, t) for k, t in enumerate(["one", "one", "a b c d e a b"])] + items[1]
    frame = spark.createDataFrame(more, "item_id long, text string")
    got = decontaminate.report(docs, frame).collect()
    same([(r.doc_id, r.n_words, r.n_hit, len(r["items"]), decontaminate.items_digest(r["items"]), r.contaminated) for r in got], brute.contamination(pairs(rows), more))
    kept = decontaminate.clean(docs, frame)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in brute.contamination(pairs(rows), more) if not w[5])


def test_long_documents_in_pieces(rows, items):
    phrases = decontaminate.Phrases.of((w, str(i)) for i, t in items[1] for w in decontaminate.windows(t))
    texts = [t for _, t in pairs(rows)]
    whole, cut = decontaminate.scan_texts(texts, phrases), decontaminate.scan_texts(texts, phrases, shard_words=500)
    assert [(f.n_words, f.merged(), f.items) for f in whole] == [(f.n_words, f.merged(), f.items) for f in cut]


# Licences ------------------------------------------------------------------------------------------


def wrapped(text, width=70):
    return "\n".join(f" * {x}" for x in textwrap.wrap(text, width))


def test_licences(spark):
    mit, full = "Released under the MIT License.", next(t.text for t in licences.TEMPLATES if t.licence == "MIT" and len(t.text) > 500)
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/x.txt", "plain words here"), ("a/b/c/COPYING", mit), ("a/b/c/d/y.txt", "more plain words"),
        ("a/b/c/z.txt", "text before\nThis work is licensed under the GNU General Public License, version 3.\ntext after"), ("e/f.txt", None), ("g.txt", ""), (None, "no path at all"),
        ("h/only.txt", mit), ("h/next.txt", "nothing"), ("a/bb/q.txt", "no licence in sight"), ("k/LICENSE", "not a licence"), ("k/w.txt", "the general public"), ("m/terms.txt", wrapped(full)), ("m/n/o.txt", "words"),
    ]
    got = {r.path: r for r in licences.scan(spark.createDataFrame([(k, t, p, "clash") for k, (p, t) in enumerate(rows)], "doc_id long, text string, path string, dir string")).collect()}
    assert (got["a/LICENSE"].licence, got["a/LICENSE"].origin) == ("Apache-2.0", "header")
    assert (got["a/b/x.txt"].licence, got["a/b/x.txt"].inherited_from) == ("Apache-2.0", "a") and got["a/bb/q.txt"].inherited_from == "a"
    assert (got["a/b/c/d/y.txt"].licence, got["a/b/c/d/y.txt"].inherited_from) == ("MIT", "a/b/c")
    assert (got["a/b/c/z.txt"].licence, got["a/b/c/z.txt"].origin) == ("GPL-3.0", "header")
    assert got["h/only.txt"].licence == "MIT" and got["h/next.txt"].licence is None  # a notice stands for no folder
    assert got["m/n/o.txt"].licence == "MIT" and got["m/n/o.txt"].inherited_from == "m"  # a full text does
    assert {got[p].origin for p in ("e/f.txt", "g.txt", "", "k/w.txt", "k/LICENSE")} == {"none"}
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string, path string")).count() == 0


WORDINGS = [
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."), (None, "This work is licensed under a Creative Commons Attribution 2.5 Generic License."),
    (None, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"), (None, "Licensed under the Apache License, Version 1.1."),
    (None, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License."), (None, "We wrote about the MIT License and the general public."), ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"), (None, "SPDX-License-Identifier: Zlib"),
]


def plain_licence(text, m):
    """The best of all passages of a text by dense vectors, none left out."""
    blocks = licences.paragraphs(text or "")
    runs = [r for r in "\0".join(b if m.maybe(b) else "" for b in blocks).split("\0\0") if r.strip("\0")]
    lines = [x for b in blocks for x in b.split("\n")]
    cuts = [c for x in lines for c in re.split(r"(?<=[.!?])(?=[ \t\r\x0b\x0c])", x)]
    best = (0.0, "")
    for passage in [text or "", *blocks, *[r.strip("\0").replace("\0", "\n") for r in runs], *lines, *cuts]:
        found = licences.terms(passage)
        vocabulary = sorted(set(found) | licences.VOCABULARY)
        vector = lambda c: np.array([c[t] * m.idf.get(t, m.rarest) for t in vocabulary])  # noqa: E731, B023
        per = {}
        for t in licences.TEMPLATES:
            if found and all(set(n) & set(found) for n in t.needs) and not set(t.bars) & set(found):
                a, b = vector(found), vector(licences.terms(t.text))
                per[t.licence] = max(per.get(t.licence, 0.0), float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))
        order = sorted(((-c, name) for name, c in per.items()))
        if order and -order[0][0] >= licences.MIN_COSINE and (len(order) < 2 or order[1][0] - order[0][0] >= licences.MARGIN):
            best = min(best, (round(order[0][0], 6), order[0][1]))
    return best[1] or None


def test_licence_names_are_right_or_none():
    freq = {t: 5 if len(t) > 6 else 60 for t in licences.VOCABULARY}
    m = licences.Matcher(100, freq)
    full = [(t.licence, t.text) for t in licences.TEMPLATES]
    for name, text in [*WORDINGS, *full]:
        for shape in (text, wrapped(text), "Some code.\n\n" + wrapped(text, 50) + "\n\nint main() { return 0 }", text.upper(), f"So we said: {text} And more."):
            got = licences.licence_of(shape, m)[0]
            assert got == plain_licence(shape, m) and got in (name, None), (name, got, shape)
        assert licences.licence_of(text, m)[0] == name, (name, text)


def test_inheritance_against_the_plain_version(spark):
    """Generated trees: licence files on several levels, ties within a folder, the root, documents with a licence of their own."""
    draw, texts = random.Random(9), [None, "words", "Released under the MIT License.", "Licensed under CC BY-SA 4.0.", *[t.text for t in licences.TEMPLATES if len(t.text) > 900]]
    docs = []
    for k in range(300):
        folder = "/".join([draw.choice("xyz"), *(draw.choice("abc") for _ in range(draw.randrange(4)))])
        name = draw.choice(["LICENSE", "COPYING", "licence.txt", "x.txt", "y.txt", "x.txt", "main.c"])
        docs.append((k, f"{folder}/{name}", draw.choices(texts, [3, 9, 2, 2] + [0.3] * (len(texts) - 4))[0]) if k % 20 else (k, "w/a/main.c", "words"))
    frame = spark.createDataFrame(docs, "doc_id long, path string, text string").repartition(4)
    m = licences.Matcher(*licences.frequencies(frame, "text"))
    best = {k: plain_licence(t, m) for k, _, t in docs}
    share = {k: (t or "") in texts[4:] for k, _, t in docs}
    named = {k: re.match(licences.FILE_NAMES, p.split("/")[-1]) is not None for k, p, _ in docs}
    want = brute.licences([(k, p) for k, p, _ in docs], best, share, named)
    same([(r.doc_id, r.licence, r.origin, r.inherited_from) for r in licences.scan(frame).collect()], want)
    assert {w[2] for w in want} == {"header", "inherited", "none"}


# Quality -------------------------------------------------------------------------------------------


def test_quality(spark, docs, rows, none):
    got = quality.verdicts(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(d, *brute.figures(t)) for d, t in pairs(rows)])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    same([(r.doc_id,) for r in kept.collect()], [(r.doc_id,) for r in got if r.kept])
    assert quality.verdicts(none).count() == 0 and quality.keep(none).count() == 0


def test_hosts(spark):
    """A host with many failures is rejected with its good documents, one with few of few is not."""
    good, bad = " ".join(f"word{k}" for k in range(40)), "too short"
    rows = [(k, bad if h == "bad" and k % 10 else bad if h == "small" and k % 2 else good, h) for h, n in (("bad", 200), ("fine", 200), ("small", 2), (None, 30)) for k in range(n)]
    got = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    kept = {h: sum(r.kept for r in got if r.host == h) for h in ("bad", "fine", "small", None)}
    assert kept == {"bad": 0, "fine": 200, "small": 1, None: 30}


# Mixing --------------------------------------------------------------------------------------------


def test_permutations(spark):
    for n in (1, 2, 7, 64, 1000):
        image = [r.x for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("x")).collect()]
        assert sorted(image) == list(range(n)) and (n < 64 or image != sorted(image))

    def hashed(*longs):
        h = 42
        for x in longs:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h

    def plain(x, n, key):
        """The same network, one step after another; rounds are 32-bit numbers in the hash."""
        for k in range(1, mixing.ROUNDS + 1):
            base = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), hashed(key) & (1 << 64) - 1)
            partner = ((base - (1 << 64) if base >> 63 else base) % n - x) % n
            if xxhash.xxh64_intdigest(max(x, partner).to_bytes(8, "little"), base) >> 63:
                x = partner
        return x

    n = 1000
    image = [r.x for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("x")).collect()]
    assert image == [plain(x, n, 9) for x in range(n)]


def test_mixing(spark, docs, rows, none):
    got = mixing.mix_report(docs).collect()
    count = {d: len(brute.WORD.findall(t or "")) for d, t in pairs(rows)}
    same([(r.doc_id, r["size"]) for r in got], [(d, count[d]) for d, _ in pairs(rows)])
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + count[r[0]]
    want, taken = brute.water(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in sizes)
    same(mixing.mix_report(docs.repartition(7)).collect(), got)
    out = mixing.mix(docs).collect()
    made = {}
    for r in out:
        made[r.doc_id] = made.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(dict(pairs(rows))[r.doc_id].split())
    by = {}
    for r in got:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.taken
    assert made == {d: n for d, n in by.items() if n} and mixing.mix(docs).columns == docs.columns
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_keeps_every_row(spark):
    """One id and text in two sources, 10,000 equal rows, equal rows but for another column, one very long text, clashing names."""
    draw = random.Random(11)
    same_text, copied, long = words(draw, 500), words(draw, 3), "\n".join(words(draw, 9) for _ in range(20_000))
    rows = [(1, same_text, "a", 1, 0), (1, same_text, "b", 2, 0), (1, same_text, None, 2, 0), (2, long, "a", 0, 0), (None, "x y", "b", 0, 0)] + [(3, copied, "c", 7, 0)] * 10_000 + [(4, "t u", "c", k, 0) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, mark long").repartition(5)
    by = lambda got, n: {k: sum(n(r) for r in got if r.source == k) for k in ("a", "b", "c", None)}
    told, made = by(mixing.mix_report(docs).collect(), lambda r: r.taken), mixing.mix(docs).collect()
    assert by(made, lambda r: len(brute.WORD.findall(r.text))) == told
    assert {r["size"] for r in made if r.doc_id == 4} <= set(range(50)) and len({r["size"] for r in made if r.doc_id == 4}) > 20
    assert {r.source for r in made if r.doc_id == 1} == {"a", "b", None}


def test_cut_keeps_what_stands_between(spark):
    text = "a  b\nc\td e f\n\ng h "
    frame = spark.createDataFrame([(text, cut) for cut in ([(0, 2)], [(1, 3), (3, 5)], [(0, 1), (2, 4), (6, 8)])], "t string, cut array<struct<w0:long,w1:long>>")
    tokens = F.regexp_extract_all("t", F.lit(f"{mixing.WORD}[{mixing.SPACE}]*"), F.lit(0))
    got = [r.x for r in frame.withColumn("w", tokens).select(mixing.cut_text("w", "cut").alias("x")).collect()]
    assert got == ["a  b", "b\nc\td e", "a\nc\td\ng h"]


def test_targets_stop_at_three_times(spark):
    draw = random.Random(8)
    for _ in range(2):
        sizes = {s: draw.choice([0, 1, 5, 40, 900]) for s in [None, "é", "z", "a", "b", "Z"]}
        frame = spark.createDataFrame([(1, s, n, 0) for s, n in sizes.items()], "doc_id long, source string, size long, mark long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        assert got == pytest.approx(brute.water(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


# The pipeline --------------------------------------------------------------------------------------


def test_pipeline(spark, docs, rows, items, tmp_path):
    import corpus_pipeline

    sf = f"file://{tmp_path}/sf"
    docs.write.parquet(f"{sf}/documents.parquet")
    items[0].write.parquet(f"{sf}/benchmark.parquet")
    step, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns
        step.write.parquet(f"{sf}/{name}")
        step = spark.read.parquet(f"{sf}/{name}")
        ids[name] = {r.doc_id for r in step.collect()}
    passed = [(d, t) for d, t in pairs(rows) if not brute.figures(t)[5]]
    assert ids["quality_rules"] <= {d for d, _ in passed}
    left = dict(p for p in passed if p[0] in ids["quality_rules"])
    assert ids["simhash_dedup"] == {c for _, _, c in brute.components([(d, brute.fingerprint(t)) for d, t in left.items()])}
    texts = [(d, left[d]) for d in ids["simhash_dedup"]]
    assert ids["benchmark_decontamination"] == {r[0] for r in brute.contamination(texts, items[1]) if not r[5]}
    assert ids["source_mixing"] <= ids["benchmark_decontamination"]
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == step.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
