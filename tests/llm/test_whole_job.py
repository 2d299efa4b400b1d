"""The corpus operators where they once did less than the whole job."""

import random
import threading

import brute
import numpy as np
import pyarrow as pa
import pytest

from tapelark.llm import common, near, queries, tokens


def words(draw, n, top=3000):
    return [f"w{draw.randrange(top)}" for _ in range(n)]


def jaccard(a, b):
    sets = []
    for t in (a, b):
        found = brute.WORD.findall(brute.az(t))
        sets.append({tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def near_copies(texts):
    """Indices of the first text of each component of pairs at 0.8 or more."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in range(len(texts))}


@pytest.mark.parametrize("short", [2, 24])
def test_near_copies_of_the_stage(spark, monkeypatch, short):
    """Copies with words changed, cut and added, on both sides of 0.8, and a group that no list's chain holds together."""
    draw = random.Random(short)
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for size in (30, 80, 200):
        for _ in range(4):
            base = words(draw, size)
            texts.append(" ".join(base))
            for k in range(1, 9):
                copy = list(base)
                for _ in range(k):
                    copy[draw.randrange(len(copy))] = f"n{draw.randrange(9999)}"
                texts.append(" ".join(copy[draw.randrange(k) :]))
    want = near_copies(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    default = near.components.__defaults__
    monkeypatch.setattr(near.components, "__defaults__", (default[0], short, 3))
    got = near.keep_one(rows)
    assert {r.doc_id for r in got.collect()} == want and 20 < len(want) < len(texts) - 20


def test_shared_shingles_in_columns(monkeypatch):
    monkeypatch.setattr(near, "_COLUMNS", 7)
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 30, 60, 60)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets]
    assert near.shared_shingles(sets, sets[2:]).tolist() == want and near.shared_shingles([], sets).shape == (0, 6)


def test_stage_uses_jaccard(spark):
    """Eight of 400 words changed: 0.82 alike, and more than two bits of a fingerprint apart."""
    import corpus_pipeline

    base = words(random.Random(1), 400)
    copy = [f"x{k}" if k % 50 == 25 else w for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(words(random.Random(2), 400)))]
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 and (brute.fingerprint(rows[0][1]) ^ brute.fingerprint(rows[1][1])).bit_count() > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()} == {1, 3}


def test_stage_keeps_rows_not_ids(spark):
    """One id on two texts loses neither; copies without an id are copies; equal rows are one."""
    rows = [(1, "a b c d e f"), (1, "something else here"), (None, "x y z"), (None, "x y z"), (2, "x y z"), (None, "only here"), (None, "only here")]
    got = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, "a b c d e f"), (1, "something else here"), (2, "x y z"), (None, "only here")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# Sentences -----------------------------------------------------------------------------------------


def test_short_and_few_sentences(spark, tmp_path):
    """Copies made of one-word sentences, of one and two long sentences, and a passage with a short end."""
    draw = random.Random(4)
    w = lambda n: " ".join(words(draw, n))
    short, one, two, tail = "\n".join(words(draw, 155)), w(60), f"{w(30)}. {w(25)}.", f"{w(50)}. {w(1)}. {w(2)}. {w(1)}."
    texts = [short, one, two, tail, short, f"{w(4)}\n{one}\n{w(3)}", two, f"{w(5)}. {tail} {w(9)}.", "one two", "one two", w(20), "\n".join(words(draw, 9))]
    texts += ["\n".join(" ".join(words(draw, draw.choice([1, 2, 5, 30]), 4)) for _ in range(draw.randrange(25))) for _ in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed_sentences for r in queries.op5_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: ",".join(map(str, x)) for k, (_, x) in brute.repeated_sentences(list(enumerate(texts))).items()}
    assert got[4] == ",".join(map(str, range(155))) and got[5] == "1" and got[6] == "0,1" and got[7] == "1,2,3,4" and got[9] == ""


# Lines ---------------------------------------------------------------------------------------------


def test_long_lines(spark, tmp_path):
    """Copies of one and two lines, a long line in another document, two lines with 50 words together; 49 words stay."""
    draw = random.Random(6)
    w = lambda n: " ".join(words(draw, n))
    one, two, pair, less, three = w(60), f"{w(55)}\n{w(3)}", f"{w(30)}\n\n{w(20)}", f"{w(30)}\n{w(19)}", f"{w(1)}\n{w(1)}\n{w(1)}"
    texts = [one, two, pair, less, three, one, f"{w(4)}\n{one}\n{w(3)}", two, f"{w(9)}\n{pair}", less, f"{w(2)}\n{three}", None, " ", " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed_lines for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: "" for k in range(len(texts))} | {5: "0", 6: "1", 7: "0,1", 8: "1,3", 10: "1,2,3"}


def test_batches_are_short_for_a_while(spark):
    """Executor and worker hold short batches while an action runs; the session's own setting comes back, and no row is lost."""
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 100, 1, 1)

    def held():
        run = lambda batches: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in batches)
        return [r.id for r in docs.mapInArrow(run, "id long").collect()]

    own = spark.conf.get(name, None)
    with common.short_batches(spark, 7):
        sizes = held()
    assert max(sizes) == 7 and sum(sizes) == 100 and spark.conf.get(name, None) == own and held() == [100]
    seen = []
    run = common.by_pieces(lambda batches: (seen.append(b.num_rows) or b for b in batches), 800)
    out = list(run(iter([pa.RecordBatch.from_pydict({"id": list(range(at, at + 250))}) for at in (0, 250)])))
    assert max(seen) <= 100 and [x for b in out for x in b.column(0).to_pylist()] == list(range(500))


def test_pipeline_remembers_fewer_units(monkeypatch):
    """The last stage says how much its workers may remember; ids are the library's whatever that is."""
    import corpus_pipeline

    asked = {}
    monkeypatch.setattr(tokens, "round_trip", lambda docs, path, **more: asked.update(more))
    corpus_pipeline.token_output(None, None, "")
    assert asked["remembered"] <= 400_000
    draw, encode = random.Random(7), tokens.Encoder(queries.tokenizer_path(), 60)
    for _ in range(30):
        texts = [" ".join(words(draw, 20, 500)) for _ in range(3)]
        for t, raw in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(encode.codes) <= 60 + 3 * 20


def test_driver_gives_memory_back(spark, monkeypatch):
    """What the driver has freed outside its heap goes back to the system, and does so while the jobs of each stage's result run."""
    import corpus_pipeline

    assert common.driver_gives_back(spark)
    seen, again = [], threading.Event()
    real = common.driver_gives_back
    monkeypatch.setattr(common, "driver_gives_back", lambda s: (seen.append(threading.current_thread().name), len(seen) > 3 and again.set(), real(s))[2])
    monkeypatch.setattr(common, "EVERY_S", 0.05)
    monkeypatch.setattr(common, "IDLE_TIMES", 10)
    monkeypatch.setattr(common, "_giver", None)
    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k}", f"s{k % 2}", 8) for k in range(6)], "doc_id long, text string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["source_mixing"](spark, docs, "")
    assert seen[0] == threading.current_thread().name and again.wait(30) and "tapelark-gives-back" in seen
    assert out.count() >= 6
    giver = common._giver
    giver.join(30)
    assert not giver.is_alive()
    for name, stage in corpus_pipeline.STAGES:
        asked = []
        monkeypatch.setattr(corpus_pipeline, "keep_giving_back", asked.append)
        with pytest.raises(Exception):  # noqa: B017, PT011  nothing to work on: only what comes first is looked at
            stage(spark, None, "")
        assert asked == [spark], name
