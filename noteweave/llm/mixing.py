"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

A tree domain -> language -> source carries a weight per node.  A budget of tokens flows down: among siblings
it is shared by weight; a child that cannot take its share (its texts times ``max_epochs``) is filled, and what is left goes
to its siblings.  Only what all siblings together cannot take is missing from their parent, whose
siblings take it in turn, because a node's capacity is the sum of its leaves'.

A leaf reads its rows in an order seeded per epoch: whole epochs first, then a prefix of the next that ends at
the exact token.  The cut of a prefix is found in a histogram of the order's hash, its boundary bin in a finer
histogram, and the rows of one fine bin in order: no task sorts a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.llm.storage import stored

#: Hex digits of the hash that name a bin; two levels of bins.
DIGITS = 3
#: Leaf tables up to this number of rows are broadcast.
SMALL = 100_000
#: Parts in which the equal rows at the end of a prefix are numbered.
SALTS = 256
LEAF = ("m_domain", "m_lang", "m_source")


@dataclass(frozen=True)
class Weights:
    """Positive integers by name for each level; other names weigh ``other`` (0: left out)."""

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1

    def column(self, level: str, name: Column) -> Column:
        out = F.lit(self.other)
        for key, weight in getattr(self, level).items():
            out = F.when(name == key, F.lit(weight)).otherwise(out)
        return out.cast("long")


def shared(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``got`` to siblings (columns weight, room and the parent's ``budget``)."""
    nodes = nodes.where("weight > 0 and room > 0")
    group = Window.partitionBy(*parent)
    rising = group.orderBy(F.col("room") / F.col("weight"), F.col(name))
    before = F.coalesce(F.sum("room").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = F.col("room").cast("double") * behind.cast("double") <= (F.col("budget") - before).cast("double") * F.col("weight").cast("double")
    marked = nodes.withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(group), F.lit(0))
    weights = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    part = F.floor(left.cast("double") * F.col("weight").cast("double") / weights.cast("double"))
    return marked.withColumn("got", F.when(F.col("full"), F.col("room")).otherwise(F.least("room", part)).cast("long")).drop("full")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Weights, max_epochs: int) -> DataFrame:
    """``got`` tokens for every leaf of (m_domain, m_lang, m_source, tokens)."""
    rooms = leaves.where("tokens > 0").withColumn("room", F.col("tokens") * max_epochs)
    langs = rooms.where(weights.column("source", F.col("m_source")) > 0).groupBy("m_domain", "m_lang").agg(F.sum("room").alias("room"))
    langs = langs.withColumn("weight", weights.column("lang", F.col("m_lang")))
    domains = langs.where("weight > 0").groupBy("m_domain").agg(F.sum("room").alias("room"))
    domains = domains.withColumn("weight", weights.column("domain", F.col("m_domain"))).withColumn("budget", budget)
    domains = shared(domains, [], "m_domain").select("m_domain", F.col("got").alias("budget"))
    langs = shared(langs.join(domains, "m_domain"), ["m_domain"], "m_lang").select("m_domain", "m_lang", F.col("got").alias("budget"))
    sources = rooms.withColumn("weight", weights.column("source", F.col("m_source"))).join(langs, ["m_domain", "m_lang"])
    return shared(sources, ["m_domain", "m_lang"], "m_source").select(*LEAF, "tokens", "got")


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def boundary(rows: DataFrame, keys: list[str], at: Column, name: str) -> DataFrame:
    """The bin in which the running sum of ``n_tokens`` passes ``need``, and what is needed of it."""
    bins = rows.groupBy(*keys, at.alias(name)).agg(F.sum("n_tokens").alias("n_tokens"), F.max("need").alias("need"))
    before = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy(name)) - F.col("n_tokens")
    found = bins.withColumn("need", F.col("need") - before).where("need > 0 and need <= n_tokens")
    return found.select(*keys, name, "need")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``m_number``, from 1 in each leaf: rows are numbered in SALTS parts of a leaf, parts by their sizes."""
    tied = stored(rows.withColumn("m_id", F.monotonically_increasing_id())).withColumn("m_salt", F.pmod("m_id", F.lit(SALTS)))
    sizes = tied.groupBy(*keys, "m_salt").agg(F.count("*").alias("m_size"))
    ahead = Window.partitionBy(*keys).orderBy("m_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("m_ahead", F.coalesce(F.sum("m_size").over(ahead), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*keys, "m_salt").orderBy("m_id"))
    return tied.join(sizes, [*keys, "m_salt"]).withColumn("m_number", F.col("m_ahead") + inside).select(*rows.columns)


def mix(
    docs: DataFrame, *, domain: str, share: float, weights: Weights, max_epochs: int = 4, seed: int = 7, tokens: str = "(length(text) + 3) div 4",
    doc: str = "doc_id", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """Selected rows with the columns of ``docs`` and domain, epoch (from 1), n_tokens and taken.

    The budget is ``share`` of the tokens of the table.  ``domain`` and ``tokens`` are SQL expressions over ``docs``.  ``taken``
    is less than ``n_tokens`` only in the last row of a leaf's prefix.  Null domain, lang or source form a leaf
    ``(none)``; rows without tokens (null or empty text) are never selected.  A repeated row is read as often as it occurs;
    rows with equal doc share their place in the order, the shorter first; of equal rows at the end of a prefix, as many are read as the
    budget takes, one of them in part.  Columns named domain, epoch, n_tokens or taken are replaced, all others are carried along under any name.
    """
    fill = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    added = {
        "m_domain": fill(F.expr(domain)), "m_lang": fill(F.col(lang)), "m_source": fill(F.col(source)),
        "m_tokens": F.coalesce(F.expr(tokens).cast("long"), F.lit(0).cast("long")), "m_key": F.coalesce(F.col(doc).cast("string"), F.lit("")),
    }
    # The input is one column from here on, so its names meet no others.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("m_row"), *(c.alias(n) for n, c in added.items())).where("m_tokens > 0")
    narrow = rows.select(*LEAF, "m_key", F.col("m_tokens").alias("n_tokens"))
    leaves = stored(narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = leaf_budgets(leaves, F.lit(int(total * share)).cast("long"), weights, max_epochs)
    plan = stored(plan.select(*LEAF, F.expr("got div tokens").alias("epochs"), F.expr("got % tokens").alias("need")))
    small = plan.count() <= SMALL  # the size is checked before a broadcast
    hint = F.broadcast if small else (lambda df: df)

    # Rows of prefixes with their place in the order.
    place = order_hash(seed, F.col("epochs") + 1, F.col("m_key"))
    placed = stored(narrow.join(hint(plan.where("need > 0")), list(LEAF)).select(*LEAF, "n_tokens", "need", place.alias("place")))
    digits = lambda level: F.substring("place", 1 + level * DIGITS, DIGITS)
    keys = list(LEAF)
    coarse = boundary(placed, keys, digits(0), "bin0")
    inside = placed.drop("need").withColumn("bin0", digits(0)).join(hint(coarse), [*keys, "bin0"])
    fine = boundary(inside, [*keys, "bin0"], digits(1), "bin1")
    last = inside.drop("need").withColumn("bin1", digits(1)).join(hint(fine), [*keys, "bin0", "bin1"])
    # Equal rows are one group from here on, however many they are.
    groups = last.groupBy(*keys, "place", "n_tokens").agg(F.count("*").alias("copies"), F.max("need").alias("need"))
    tokens_of = F.col("copies") * F.col("n_tokens")
    ordered = Window.partitionBy(*keys).orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = groups.withColumn("rest", F.col("need") - F.sum(tokens_of).over(ordered) + tokens_of).where("rest > 0")
    place_of = F.struct("place", "n_tokens")
    cuts = ends.groupBy(*keys).agg(
        F.max("place").alias("cut"), *(F.max_by(c, place_of).alias(n) for c, n in (("rest", "rest"), ("n_tokens", "cut_tokens"), ("copies", "copies")))
    )
    plan = stored(plan.join(cuts, keys, "left"))

    mine = order_hash(seed, F.col("epochs") + 1, F.col("m_key"))
    joined = rows.join(hint(plan), keys).withColumns({"m_place": F.when(F.col("cut").isNotNull(), mine), "m_number": F.lit(1).cast("long")})
    before = (F.col("m_place") < F.col("cut")) | ((F.col("m_place") == F.col("cut")) & (F.col("m_tokens") < F.col("cut_tokens")))
    at_cut = F.coalesce((F.col("m_place") == F.col("cut")) & (F.col("m_tokens") == F.col("cut_tokens")), F.lit(False))
    if plan.where("copies > 1").limit(1).count():
        tied = at_cut & (F.col("copies") > 1)
        joined = joined.where(~tied).unionByName(numbered(joined.where(tied), keys))
    partial = F.when(before, F.col("m_tokens")).when(at_cut, F.greatest(F.lit(0), F.least(F.col("m_tokens"), F.col("rest") - (F.col("m_number") - 1) * F.col("m_tokens")))).otherwise(0)
    joined = joined.withColumn("m_partial", F.coalesce(partial, F.lit(0)).cast("long"))
    times = F.col("epochs") + (F.col("m_partial") > 0).cast("long")
    exploded = joined.where(times > 0).withColumn("m_epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    kept = [F.col("m_row")[c].alias(c) for c in docs.columns if c.lower() not in ("domain", "epoch", "n_tokens", "taken")]
    taken = F.when(F.col("m_epoch") <= F.col("epochs"), F.col("m_tokens")).otherwise(F.col("m_partial"))
    return exploded.select(*kept, F.col("m_domain").alias("domain"), F.col("m_epoch").alias("epoch"), F.col("m_tokens").alias("n_tokens"), taken.alias("taken"))
