"""Operator 7, mixing to target weights: hierarchical budgets and seeded epochs, in DataFrame functions.

Sources are leaves of a tree of domain, language and source. The token budget
goes down the tree by weight; no node gets more than its leaves hold over
``max_epochs`` epochs, and what it cannot use goes to its siblings by their
weights. Only when a whole family is full does the rest go to the siblings of
its parent: the parent's own bound is the sum of its children's. Each leaf then
takes whole epochs of its documents and a prefix of the next one: an epoch is
the order of its documents by a hash of seed, epoch and doc_id, and the prefix
holds the documents whose running tokens stay within the budget.

Running sums never order a whole leaf in one task: the range of the hash is cut
into ``PARTS`` parts, whose sums tell the part at which the budget ends; that
part is cut in its turn until at most ``bucket`` documents of a leaf are in it,
and only those are ordered document by document.

Defined results: null and empty texts have no tokens and are taken with the
documents before them; null languages or sources are leaves of their own;
sources without a weight get ``default``; rows that share a doc_id stand or fall
together; no row at all gives no row. Columns of any name pass through, but
``domain``, ``tokens`` and ``epoch``, which the results replace.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyflow.llm.common import quoted, settle

LEVELS = ("domain", "lang", "source")
BITS, PARTS = 60, 1024


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def weight_of(name: Column, weights: Mapping[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for k, v in weights.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share out each parent's ``budget`` among its children by weight ``w``, none over its ``cap``.

    In order of cap per weight the full children come first: a child is full if
    the rest of the budget, shared by the rest of the weight, exceeds its cap.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    past, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    x = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(past), F.lit(0))).withColumn("ws", F.sum("w").over(rest))
    x = x.withColumn("full", F.col("cap").cast("double") * F.col("ws") <= F.col("left").cast("double") * F.col("w"))
    whole = Window.partitionBy(*parent)
    x = x.withColumn("free", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))).withColumn("fw", F.max(F.when(~F.col("full"), F.col("ws"))).over(whole))
    return x.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("free") * F.col("w") / F.col("fw"))))).drop("left", "ws", "full", "free", "fw")


def budgets(leaves: DataFrame, total: int, weights: Mapping[str, Mapping[str, float]], *, max_epochs: int = 3, default: float = 1.0) -> DataFrame:
    """Token budget of every leaf; ``leaves`` has the levels, ``tokens`` and ``n``."""
    x = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    given, parent = None, []
    for level in LEVELS:
        names = [*parent, level]
        nodes = x.groupBy(*names).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(F.col(level), weights.get(level, {}), default))
        if given is None:
            nodes = nodes.withColumn("root", F.lit(0)).withColumn("budget", F.least(F.lit(int(total)).cast("long"), F.sum("cap").over(Window.partitionBy("root"))))
            given = filled(nodes, ["root"], level).select(*names, "budget")
        else:
            given = filled(nodes.join(given, parent), parent, level).select(*names, "budget")
        parent = names
    return leaves.join(given, list(LEVELS))


def place(key: Column, epoch: Column, seed: int) -> Column:
    """The document's place in an epoch: 60 bits of a hash."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, float]], *, share: float = 0.6, max_epochs: int = 3, seed: int = 1, bucket: int = 512, key: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` chosen for training, once for each epoch they are in.

    The budget is ``share`` of all tokens. Adds domain, tokens and epoch to ``columns`` (all by default).
    """
    names = [c for c in (columns or docs.columns) if c.lower() not in ("domain", "tokens", "epoch")]
    leaf = [F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source")]
    # the columns of docs travel as one struct: none can clash with those that are made here
    rows = docs.select(F.struct(*map(quoted, names)).alias("row"), quoted(key).alias("id"), *leaf, tokens_of(quoted(text)).alias("tokens"))
    slim = settle(rows.drop("row"), "slim")
    leaves = settle(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = budgets(leaves, int(total * share), weights, max_epochs=max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int"))
    plan = settle(plan.select(*LEVELS, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("past")), "plan")

    shift, step = BITS, PARTS.bit_length() - 1
    while shift > 0:
        shift -= step
        plan, most = narrowed(slim, plan, shift, step, seed)
        if most <= bucket:
            break

    x = rows.withColumnRenamed("tokens", "size").join(plan, list(LEVELS)).withColumn("u", place(F.col("id"), F.col("epochs"), seed)).withColumn("own", F.shiftright("u", shift))
    kept = [*(F.col("row").getField(c).alias(c) for c in names), F.col("domain"), F.col("size").alias("tokens")]
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>"))
    before = (F.col("rest") > 0) & (F.col("own") < F.col("part"))
    sure = x.withColumn("at", F.explode(F.when(before, F.concat(whole, F.array("epochs"))).otherwise(whole))).select(*kept, F.col("at").alias("epoch"))
    order = Window.partitionBy(*LEVELS).orderBy("u", "id")
    edge = x.filter((F.col("rest") > 0) & (F.col("own") == F.col("part"))).withColumn("run", F.col("past") + F.sum("size").over(order)).filter("run <= rest")
    return sure.unionAll(edge.select(*kept, F.col("epochs").alias("epoch")))


def narrowed(slim: DataFrame, plan: DataFrame, shift: int, step: int, seed: int) -> tuple[DataFrame, int]:
    """The plan with each leaf's part cut further, to the one at which its budget ends, and the most rows in such a part.

    At most 2 ** step sums of a leaf are put in order.
    """
    x = slim.join(plan.filter("rest > 0"), list(LEVELS)).withColumn("u", place(F.col("id"), F.col("epochs"), seed)).filter(F.shiftright("u", shift + step) == F.col("part"))
    sums = x.groupBy(*LEVELS, "rest", "past", F.shiftright("u", shift).alias("cut")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    run = sums.withColumn("before", F.col("past") + F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("cut")) - F.col("t")).filter("before + t > rest")
    ends = settle(run.groupBy(*LEVELS).agg(F.min(F.struct("cut", "before", "n")).alias("end")).select(*LEVELS, "end.cut", "end.before", "end.n"), "ends")
    plan = settle(plan.join(ends, list(LEVELS), "left").select(*LEVELS, "epochs", "rest", F.coalesce("cut", F.lit(1 << (BITS - shift))).alias("part"), F.coalesce("before", "past").alias("past")), "plan")
    return plan, ends.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
