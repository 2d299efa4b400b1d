"""Mixing sources to target weights by token blocks, from DataFrame functions only.

The words of a source, in the order of its documents, are packed into blocks of ``BLOCK`` words (the
last is shorter). A source's target in words becomes a number of slots. All slots are dealt to output
shards of ``SHARD`` slots, which draws the counts of sources of each shard: a multinomial draw given
the totals, so that totals are met exactly. The slots of a source are numbered over the shards, and
each number goes through a pseudorandom permutation of the source's block indexes, a new one for
each pass over it. Slots and blocks are joined by index.

Permutations are swap-or-not networks: round k pairs x with (key_k - x) mod n and swaps the pair by a
hash bit of its larger member, which is a bijection for every n and needs no state and no sort.

Defined cases: null and blank texts have size 0 and nothing is taken; a null source is a source, last
in order; an empty table or one without words gives no slots; rows equal in all columns are rows of their
own, each with its own blocks; one id or text in two sources is two documents; columns of any name come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelark.llm.common import SPACES, WORD, materialize, once, sized, words

SPACE = r"\x20\x09-\x0D"
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK, SHARD, SEED = 64, 65536, 42
ROUNDS = 24
#: Documents of a source that are ordered together, about.
RUN = 10_000


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Image of x under a pseudorandom permutation of 0..n-1 chosen by the long ``key``."""

    def one(v: Column, k: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, k), n) - v, n)
        return F.aggregate(F.array(partner), v, lambda a, o: F.when(F.xxhash64(key, k, F.greatest(a, o)) < 0, o).otherwise(a))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), one)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def row_key(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What tells rows apart: id, source, size and a hash of all columns but maps. Rows that agree in it can stand for each other."""
    return {
        "doc_id": F.col(id_col),
        "source": F.col(source_col).cast("string"),
        "size": F.size(words(F.col(text_col))).cast("long"),
        "mark": F.xxhash64(*[F.col(f.name) for f in docs.schema if _hashable(f.dataType)]),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, mark) per row."""
    return docs.select(*[c.alias(k) for k, c in row_key(docs, id_col, text_col, source_col).items()])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """(source, rank, weight, source_size, target): one row per source.

    Weights repeat over the sources in code point order, null last. Targets share the whole size by
    weight and stop at ``passes`` times their source's size; the excess is shared anew by weight until
    none is above. A round of that is one aggregation whose two sums reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    table = materialize(ranked.withColumn("weight", pick), "sources")
    total, heavy = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total, heavy, limit = total or 0, heavy or 0, F.col("source_size") * passes
    left, open_, capped = total, heavy, -1
    while open_:
        # A source stays open while its limit is above its share: limit * open >= left * weight.
        full = limit * F.lit(float(open_)) < F.lit(float(left)) * F.col("weight")
        n, held, gone = table.filter(full).agg(F.count(F.lit(1)), F.sum(limit), F.sum("weight")).first()
        if n == capped:
            break
        capped, left, open_ = n, total - (held or 0), heavy - (gone or 0)
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(open_ or 1))
    target = F.least(limit.cast("double"), share) if open_ else limit.cast("double")
    return table.withColumn("target", target)


def placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` of documents with words, with ``start``: the words before it in its source.

    Two levels of sums, so that no task orders a whole source: documents are cut by a hash of their id
    into runs of about RUN, ordered within a run; the runs' totals are added up by source.
    """
    runs = F.greatest(F.lit(1), F.ceil(F.col("docs") / RUN))
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs")).select(F.col("source").alias("_s"), runs.cast("long").alias("runs"))
    filled = sizes.filter("size > 0").join(sized(materialize(per, "runs")), F.col("source").eqNullSafe(F.col("_s")))
    cut = filled.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.col("runs"))).drop("_s", "runs")
    inner = Window.partitionBy("source", "run").orderBy("doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    sums = cut.groupBy("source", "run").agg(F.sum("size").alias("words"))
    outer = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("_s"), F.col("run").alias("_r"), F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("base"))
    joined = rows.join(sized(materialize(base, "bases")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("run") == F.col("_r")))
    return joined.withColumn("start", F.col("base") + F.col("before")).drop("_s", "_r", "base", "before", "run")


def slots(goal: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, passes: int = MAX_PASSES) -> DataFrame:
    """(rank, shard, slot, index): for each slot of the mix, the block of its source that fills it.

    ``goal`` is a materialized result of ``targets``.
    """
    blocks = F.ceil(F.col("source_size") / block)
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0)
    per = goal.withColumn("blocks", blocks.cast("long")).withColumn("n", F.least(wanted.cast("long"), passes * blocks).cast("long"))
    order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("rank", "blocks", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    per = materialize(per, "slots")
    every = max(1, per.agg(F.sum("n")).first()[0] or 0)
    step = 4096
    # A number of its own: by size alone, the short rows below would be put in one partition before they unfold.
    parts = max(2 * goal.sparkSession.sparkContext.defaultParallelism, every // 100_000)
    dealt = (
        per.filter("n > 0")
        .withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
        .repartition(parts, "rank", "lot")
        .withColumn("r", F.explode(F.sequence(F.col("lot"), F.least(F.col("n"), F.col("lot") + step) - 1)))
        .withColumn("at", permuted(F.col("first") + F.col("r"), F.lit(every).cast("long"), F.lit(seed).cast("long")))
    )
    drawn = dealt.groupBy("rank", F.floor(F.col("at") / shard).cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("drawn"))
    along = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.withColumn("offset", F.coalesce(F.sum("drawn").over(along), F.lit(0)))
    numbered = counts.join(sized(per.select("rank", "blocks"), per), "rank").withColumn(
        "lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1, F.lit(step).cast("long")))
    )
    numbered = numbered.repartition(parts, "rank", "shard", "lot").withColumn(
        "slot", F.explode(F.sequence(F.col("offset") + F.col("lot"), F.col("offset") + F.least(F.col("drawn"), F.col("lot") + step) - 1))
    )
    passed = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    keyed = once(numbered, "key", F.xxhash64(F.lit(seed), "rank", passed))
    return keyed.select("rank", "shard", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("key")).alias("index"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per document and block: index, and the document's words [w0, w1) in that block."""
    out = rows.withColumn(
        "index", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    )
    w0 = F.greatest(F.lit(0), F.col("index") * block - F.col("start"))
    w1 = F.least(F.col("size"), (F.col("index") + 1) * block - F.col("start"))
    return out.withColumn("w0", w0.cast("long")).withColumn("w1", w1.cast("long"))


def mixed(sizes: DataFrame, goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pieces of documents with ``times``, the number of slots that hold them; left out if none does.

    ``sizes`` and ``goal`` are materialized results of ``measured`` and ``targets``.
    """
    ranks = goal.select(F.col("source").alias("_s"), "rank")
    rows = placed(sizes).join(sized(ranks, goal), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    used = slots(goal, block).groupBy("rank", "index").agg(F.count(F.lit(1)).alias("times"))
    return pieces(rows, block).join(used, ["rank", "index"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, size, source, source_size, target, taken."""
    sizes = materialize(measured(docs, id_col, text_col, source_col), "sizes")
    goal = materialize(targets(sizes), "targets")
    per = mixed(sizes, goal).groupBy("rank", "start").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum((F.col("w1") - F.col("w0")) * F.col("times")).alias("taken")
    )
    empty = sizes.filter("size = 0").join(sized(goal.select(F.col("source").alias("_s"), "rank"), goal), F.col("source").eqNullSafe(F.col("_s")))
    rows = per.select("rank", "doc_id", "size", "taken").unionByName(empty.select("rank", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    return rows.join(sized(goal.select("rank", "source", "source_size", "target"), goal), "rank").drop("rank")


def held_parts(held: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark, cut): for each row and pass k that holds something of it, its word ranges (w0, w1) that slots hold k times or more.

    Ranges are gathered by row (a source and a start), so a list is no longer than its own document.
    """
    per = held.groupBy("rank", "start").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "mark")], F.array_sort(F.collect_list(F.struct("w0", "w1", "times"))).alias("parts")
    )
    passes = F.transform(
        F.sequence(F.lit(1).cast("long"), F.lit(MAX_PASSES).cast("long")),
        lambda k: F.transform(F.filter("parts", lambda p: p["times"] >= k), lambda p: F.struct(p["w0"].alias("w0"), p["w1"].alias("w1"))),
    )
    each = per.select("doc_id", "source", "size", "mark", F.explode(passes).alias("cut"))
    return each.filter(F.size("cut") > 0)


def cut_text(tokens: str, cut: str) -> Column:
    """Text of the word ranges ``cut``; ``tokens`` are the words, each with the white space behind it.

    Neighbouring ranges go on as in the text, others are apart by a line end.
    """

    def one(p: Column, i: Column) -> Column:
        part = F.array_join(F.slice(F.col(tokens), (p["w0"] + 1).cast("int"), (p["w1"] - p["w0"]).cast("int")), "")
        after = F.get(F.col(cut), i + 1)["w0"]
        bare = F.rtrim(part, F.lit(SPACES))
        return F.when(after == p["w1"], part).when(after.isNotNull(), F.concat(bare, F.lit("\n"))).otherwise(bare)

    return F.array_join(F.transform(F.col(cut), one), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mixed corpus with the columns of ``docs``: for each pass k, what slots hold of a document k times or more.

    A document held whole keeps its text as it is; else its text is the held words with what stands between
    them. ``chars_col``, if there, is the new text's length. By source, its words are those of ``mix_report``.
    """
    own = docs.columns
    sizes = materialize(measured(docs, id_col, text_col, source_col), "sizes")
    goal = materialize(targets(sizes), "targets")
    cuts = materialize(held_parts(mixed(sizes, goal).filter("times > 0")), "cuts")
    key = ["doc_id", "source", "size", "mark"]
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(own)], *[c.alias(k) for k, c in row_key(docs, id_col, text_col, source_col).items()]).filter("size > 0")
    twice = materialize(sizes.filter("size > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    if not twice.isEmpty():
        # One row stands for those that agree in all columns; as many lists of ranges are joined to it as there are rows.
        same = twice.select(*[F.col(k).alias(f"_{k}") for k in key])
        agree = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        one = rows.join(sized(same, twice), agree, "left_semi").groupBy(*key).agg(F.any_value(F.struct(*[f"c{k}" for k in range(len(own))])).alias("r"))
        rows = rows.join(sized(same, twice), agree, "left_anti").unionByName(one.select("r.*", *key))
    asked = cuts.select(*[F.col(k).alias(f"_{k}") for k in key], "cut")
    copies = rows.join(asked, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    text = F.col(f"c{own.index(text_col)}")
    count = F.aggregate("cut", F.lit(0).cast("long"), lambda n, p: n + p["w1"] - p["w0"])
    copies = once(copies, "tokens", F.when(count < F.col("size"), F.regexp_extract_all(text, F.lit(f"{WORD}[{SPACE}]*"), F.lit(0))))
    copies = once(copies, "new", F.when(F.col("tokens").isNull(), text).otherwise(cut_text("tokens", "cut")))
    out = []
    for k, c in enumerate(own):
        kind = docs.schema[c].dataType
        out.append((F.col("new") if c == text_col else F.length("new").cast(kind) if c == chars_col else F.col(f"c{k}")).alias(c))
    return copies.select(*out)
