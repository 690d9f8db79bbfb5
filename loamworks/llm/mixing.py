"""Mixing sources to target shares of tokens (problem 7).

Documents of a source are packed end to end, in a pseudorandom order, into a stream of
tokens cut into fixed-length blocks. How many tokens, and so blocks, a source gives follows
from its target; the documents that lie in these blocks are the mix. Output shards draw how
many of their slots each source gets: multinomial counts conditioned on the exact totals
(drawn without replacement), since free draws would miss the target shares by their sampling
error. The draws form a seeded tree that halves the shards, so each task draws its own shards
and none is planned on the driver. A slot's number maps through the source's pseudorandom
index permutation to a block, and blocks are joined by index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.llm.tokenize import token_count
from loamworks.operators.ranges import running
from loamworks.session import cut

BLOCK = 1024  # tokens of a block
SLOTS = 256  # blocks of an output shard
TARGETS_MOST = 10_000  # named sources at most; more are an error
DRAWN_MOST = 500_000_000  # blocks up to which a node of the tree is drawn; larger ones are split in proportion, whose error is far below a block in a million


def permuted_index(slot: Column, n: Column, seed: Column) -> Column:
    """The place of each slot under its seed's pseudorandom permutation of 0..n-1."""

    @F.pandas_udf(T.LongType())
    def walk(s: pd.Series, m: pd.Series, r: pd.Series) -> pd.Series:
        out = np.zeros(len(s), np.int64)
        for (size, mixed), rows in pd.Series(np.arange(len(s))).groupby([m.to_numpy(), r.to_numpy()]):
            at, k = rows.to_numpy(), s.to_numpy()[rows.to_numpy()].astype(np.int64)
            out[at] = feistel(k, int(size), int(mixed))
        return pd.Series(out)

    return walk(slot, n, seed)


def feistel(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 applied to k: four Feistel rounds on the covering square, walked until inside."""
    if n <= 1:
        return np.zeros(k.size, np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence([seed & 0xFFFFFFFFFFFFFFFF]).generate_state(4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(33)) & low
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        x = once(k.astype(np.uint64))
        outside = np.flatnonzero(x >= n)
        while outside.size:
            x[outside] = once(x[outside])
            outside = outside[x[outside] >= n]
    return x.astype(np.int64)


@dataclass
class Budget:
    """What a named source has and gives: whole passes over its documents, and `rest` tokens of one more."""

    source: str
    target_share: float
    max_repeats: int
    source_docs: int = 0
    source_tokens: int = 0
    total_tokens: int = 0
    ahead: int = 0  # tokens of the sources before it in order

    @property
    def budget(self) -> int:
        """The share of the total, or all that max_repeats uses give."""
        return min(math.floor(self.target_share * self.total_tokens + 0.5), self.max_repeats * self.source_tokens)

    @property
    def passes(self) -> int:
        return self.budget // self.source_tokens if self.source_tokens else 0

    @property
    def rest(self) -> int:
        return self.budget - self.passes * self.source_tokens


def named(targets: DataFrame) -> dict[str, Budget]:
    """The targets by source. A null share or limit counts as 0; a source named twice gets the sum of its shares and the larger limit."""
    grouped = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("repeats"))
    rows = grouped.limit(TARGETS_MOST + 1).collect()
    if len(rows) > TARGETS_MOST:
        raise ValueError(f"more than {TARGETS_MOST} named sources")
    return {r["source"]: Budget(r["source"], float(r["share"]), int(r["repeats"])) for r in rows}


def sized(documents: DataFrame, sources: list[str], key: str = "doc_id", source: str = "source", text: str = "text", **tokenizer) -> DataFrame:
    """doc_id, source, tokens and place of the documents of named sources; the place is a pseudorandom number.

    The text goes no further than this projection; documents of other or no sources are left out.
    """
    names = documents.sparkSession.createDataFrame([(s,) for s in sources], "_s string")  # at most TARGETS_MOST
    kept = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_text"))
    kept = kept.join(F.broadcast(names), F.col("source") == F.col("_s"), "left_semi")
    return kept.select("doc_id", "source", token_count(F.col("_text"), **tokenizer).alias("tokens"), F.xxhash64(F.col("doc_id"), F.lit(7)).alias("place"))


@dataclass
class Mix:
    """documents: doc_id, source, tokens, start (in the source's stream), uses, extra (a use beyond the whole passes), at (the place of that use)."""

    documents: DataFrame
    budgets: dict[str, Budget]

    def shares(self) -> DataFrame:
        """One row for each target: what was asked for and what the mix holds."""
        spark = self.documents.sparkSession
        used = {r["source"]: r for r in self.documents.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t"), F.count(F.lit(1)).alias("d"), F.max("uses").alias("m")).collect()}  # a row for each target
        mix = sum(r["t"] for r in used.values())
        rows = []
        for b in self.budgets.values():
            t, d, m = (used[b.source][c] for c in ("t", "d", "m")) if b.source in used else (0, 0, 0)
            rows.append((b.source, b.target_share, b.max_repeats, b.source_docs, b.source_tokens, b.total_tokens, d, t, m, t / b.total_tokens if b.total_tokens else 0.0, t / mix if mix else 0.0))
        return spark.createDataFrame(rows, "source string, target_share double, max_repeats long, source_docs long, source_tokens long, total_tokens long, used_docs long, used_tokens long, most_uses int, actual_share double, mix_share double")


def mix(documents: DataFrame, targets: DataFrame, **options) -> Mix:
    """The documents that are used, and how often, so that each source gives its share of all tokens of named sources used once.

    Every document of a source is used `passes` times. Those at the head of its stream are used once more, as far as
    they do not exceed `rest`; of the documents after them the one that brings the source nearest to `rest` follows, if any
    does. Places in the streams are running sums taken range by range, so no source, however large, is put in order
    by one task. Documents without a use are left out. Rows of the same doc_id count as documents of their own.
    """
    spark = documents.sparkSession
    budgets = named(targets)
    d = cut(sized(documents, sorted(budgets), **options))  # tokens are counted once; a few numbers a document are kept
    for r in d.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():  # a row for each target
        budgets[r["source"]].source_tokens, budgets[r["source"]].source_docs = int(r["t"]), r["n"]
    total = sum(b.source_tokens for b in budgets.values())
    before = 0
    for s in sorted(budgets, key=lambda x: x.encode("utf-8", "surrogatepass")):  # the order in which Spark sorts text
        budgets[s].total_tokens, budgets[s].ahead = total, before
        before += budgets[s].source_tokens
    plan = F.broadcast(spark.createDataFrame([(b.source, b.passes, b.rest, b.ahead) for b in budgets.values()], "source string, passes long, rest long, ahead long"))  # at most TARGETS_MOST
    order = [F.col("source"), F.col("place"), F.col("doc_id"), F.col("tokens")]
    r = running(d, order, {"upto": F.col("tokens")}).join(plan, "source")
    r = cut(r.select("doc_id", "source", "tokens", (F.col("upto") - F.col("ahead") - F.col("tokens")).alias("start"), "passes", "rest", F.expr("rest > 0 AND upto - ahead <= rest").cast("int").alias("extra")))
    gaps = {x["source"]: budgets[x["source"]].rest - int(x["t"]) for x in r.groupBy("source").agg(F.sum(F.col("tokens") * F.col("extra")).alias("t")).collect()}
    open_gaps = F.broadcast(spark.createDataFrame([(s, g, budgets[s].rest - g) for s, g in gaps.items() if g > 0], "source string, gap long, filled long"))  # at most TARGETS_MOST
    left = r.filter("extra = 0 AND rest > 0 AND tokens > 0").join(open_gaps, "source")
    off = F.abs(F.col("gap") - F.col("tokens"))
    fits = left.filter(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("start"), F.col("doc_id"), F.col("filled"))).alias("b")).collect()  # a row for each target
    # a place in the stream names a row, as documents of no tokens are never chosen here
    fit = F.broadcast(spark.createDataFrame([(x["source"], x["b"]["start"], x["b"]["filled"]) for x in fits], "_s string, _start long, _at long"))
    r = r.join(fit, (F.col("source") == F.col("_s")) & (F.col("start") == F.col("_start")) & (F.col("tokens") > 0), "left")
    more = F.col("extra") + F.col("_at").isNotNull().cast("int")
    out = r.select("doc_id", "source", "tokens", "start", (F.col("passes") + more).cast("int").alias("uses"), more.alias("extra"), F.coalesce("_at", "start").alias("at")).filter("uses > 0")
    return Mix(cut(out), budgets)


def mixed(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The mix: doc_id, source, tokens, uses, and its source's target and actual share.

    actual_share is the source's tokens in the mix over the tokens of all documents of named
    sources used once; mix_share is over all tokens in the mix. An empty table, or one in which
    no source is named, gives an empty mix. Null and empty texts have 0 tokens.
    """
    m = mix(documents, targets, **options)
    return m.documents.join(F.broadcast(m.shares().select("source", "target_share", "actual_share", "mix_share")), "source").select("doc_id", "source", "tokens", "uses", "target_share", "actual_share", "mix_share")


def packed(m: Mix, block: int = BLOCK) -> DataFrame:
    """source, block_no, block_from, doc_id, use_no, token_from, token_to: which tokens of which document fill each block.

    Pass after pass of a source is laid end to end, then the uses beyond them. A document that spans several blocks
    has a row in each. Documents of 0 tokens take no place.
    """
    totals = m.documents.sparkSession.createDataFrame([(b.source, b.source_tokens) for b in m.budgets.values()], "source string, source_tokens long")
    each = m.documents.filter("tokens > 0").join(F.broadcast(totals), "source")  # at most TARGETS_MOST
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("use_no"))
    last = F.col("use_no") > F.col("uses") - F.col("extra")
    at = F.when(last, (F.col("uses") - F.col("extra")) * F.col("source_tokens") + F.col("at")).otherwise((F.col("use_no") - 1) * F.col("source_tokens") + F.col("start"))
    each = each.withColumn("_p", at).withColumn("block_no", F.explode(F.sequence(F.floor(F.col("_p") / block), F.floor((F.col("_p") + F.col("tokens") - 1) / block))))
    lo = F.greatest(F.col("_p"), F.col("block_no") * block)
    hi = F.least(F.col("_p") + F.col("tokens"), (F.col("block_no") + 1) * block)
    return each.select("source", "block_no", (lo - F.col("block_no") * block).cast("int").alias("block_from"), "doc_id", "use_no", (lo - F.col("_p")).alias("token_from"), (hi - F.col("_p")).alias("token_to"))


def shard_draw(shard: int, shards: int, totals: np.ndarray, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source in the shards before this one, blocks of each in it): a leaf of the seeded tree that halves the shards.

    At each node the first half's blocks are drawn from those at hand without replacement; the node's own seed makes
    every task draw the same. All shards but the last hold `slots` blocks.
    """
    lo, hi, left, given = 0, shards, totals.astype(np.int64), np.zeros(totals.size, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        size, total = slots * (mid - lo), int(left.sum())
        if total <= DRAWN_MOST:
            draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(left, size, method="marginals")
        else:
            wish = [int(x) * size for x in left]
            draw = np.array([w // total for w in wish], np.int64)
            for k in sorted(range(len(wish)), key=lambda k: -(wish[k] % total))[: size - int(draw.sum())]:
                draw[k] += 1
        if shard < mid:
            left, hi = draw, mid
        else:
            left, given, lo = left - draw, given + draw, mid
    return given, left


def block_plan(m: Mix, block: int = BLOCK, slots: int = SLOTS, seed: int = 7) -> DataFrame:
    """Every slot of every output shard with the block it takes: shard, slot (of the source), source, block_no.

    The tokens in the mix of each source make up blocks of `block` tokens (the last may be short). Only the
    number of tokens of each target reaches the driver; shards are drawn by tasks.
    """
    spark = m.documents.sparkSession
    sums = {r["source"]: -(-int(r["t"]) // block) for r in m.documents.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t")).collect()}  # a row for each target
    names = sorted(s for s, n in sums.items() if n > 0)
    totals = np.array([sums[s] for s in names], np.int64)
    shards = -(-int(totals.sum()) // slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for shard in b["id"]:
                given, own = shard_draw(int(shard), shards, totals, slots, seed)
                rows += [(int(shard), names[k], int(given[k]), int(own[k]), int(totals[k]), seed + 1 + k) for k in np.flatnonzero(own)]
            yield pd.DataFrame(rows, columns=["shard", "source", "first_slot", "n", "blocks", "seed"])

    plan = spark.range(shards).mapInPandas(draw, "shard long, source string, first_slot long, n long, blocks long, seed long")
    each = plan.select("shard", "source", "blocks", "seed", F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("n") - 1)).alias("slot"))
    return each.select("shard", "slot", "source", permuted_index(F.col("slot"), F.col("blocks"), F.col("seed")).alias("block_no"))


def sharded(m: Mix, block: int = BLOCK, slots: int = SLOTS, seed: int = 7) -> DataFrame:
    """What fills each slot: the plan joined to the blocks by index; shard, slot, source, block_no, block_from, doc_id, use_no, token_from, token_to."""
    return block_plan(m, block, slots, seed).join(packed(m, block), ["source", "block_no"]).select("shard", "slot", "source", "block_no", "block_from", "doc_id", "use_no", "token_from", "token_to")
