"""Exact join of documents on the Jaccard similarity of their word shingles, by prefixes of token combinations.

Two sets whose similarity reaches the threshold share all but a few tokens, so in any order of tokens that is the same for
all documents they share their first two common tokens among the first ``n - ceil(t n) + 2`` of each. The join works on the classes
of documents with equal sets, in these steps:

1.  Each document gives the smallest of its token hashes (more than its prefix holds), its set's size and digest.
2.  Tokens that stand in several prefixes link each holder with the token's first holder as a candidate. Groups of near
    copies, however large, come together here with one candidate for each document and token, not one for each pair.
3.  Only tokens that still hold several components can link more. Those with many components (passages that unrelated
    documents share) are the frequent class: they go last in the order, so prefixes that hold them are extended by rarer tokens,
    read from the text where the smallest hashes do not suffice; tokens that turn out frequent then join the class in a second
    round. Tokens of few holders then pair these directly.
4.  Documents whose prefix still holds frequent tokens, or tokens of many holders, are left (large groups of copies that are
    not all alike). Their whole sets are counted and put in order anew, rarest tokens first. Tokens of one document alone
    stand in front: a document with too many of them to reach the threshold with anything has none of the others left in its
    prefix, and the place of a token in the order bounds the sizes of sets that can be reached by it.
5.  Each of these tokens' holders are held against the one with the fewest tokens of its own, the nearest to what they are
    copies of.
6.  What is left open meets by keys: a token of the rare class by itself, and for the frequent class pairs of tokens of the
    prefix that is extended by one. Only holders of different components are paired, and a key's largest component never
    with itself.

A candidate is first held against what both sketches prove about the difference of the sets, which nearly all false
ones fail; the others are compared by the whole texts' sets. No step sends a token's holders to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from opslens.llm.components import components, merged
from opslens.llm.shingles import WIDTH, digest, shingle_sets
from opslens.llm.staging import make_room, staged, tidy

#: Threshold in hundredths: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 90
#: Holders of a token above which it is frequent and counts in pairs only.
FREQUENT = 24
#: Frequent tokens that join the class in a round at most, the most frequent first, and rounds; documents of tokens that turn
#: out frequent after them are put in order by whole sets.
KNOWN, ROUNDS = 200_000, 2
#: Holders of a rare token up to which its candidates are paired directly.
DIRECT = 64
#: Holders of a key that meet in one task, about.
SLOT = 512
#: Bits of the filter that picks the documents whose texts are fetched.
FILTER_BITS = 1 << 24
CHUNK = 400_000
#: Rows of a batch that are turned into Python objects at once.
ROWS = 256

_SKETCH = "doc_id long, text_hash long, n long, high long, low long, tokens array<long>"


def least_size(threshold: int) -> int:
    """Sets smaller than this reach the threshold only with equal sets."""
    return -(-threshold // (100 - threshold))


def prefix_length(n: Column, threshold: int) -> Column:
    """Tokens of a set of ``n`` among which two common ones must be."""
    return n - F.floor((n * threshold + 99) / 100) + 2


def _sketcher(threshold: int, width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for at, texts in _portions(batch.column(2)):
                rows = []
                for own in shingle_sets(texts, width):
                    n = len(own)
                    prefix = n - (n * threshold + 99) // 100 + 2
                    tokens = own[: prefix + prefix // 2 + 8] if n >= least_size(threshold) else own[:0]
                    rows.append((n, *digest(own), tokens))
                flat = np.concatenate([r[3] for r in rows])
                offsets = np.cumsum([0] + [len(r[3]) for r in rows])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(rows)), hashes.slice(at, len(rows)), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))],
                    names=["doc_id", "text_hash", "n", "high", "low", "tokens"])

    return sketch


def _portions(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about CHUNK characters, with the place of the first."""
    held, size, start = [], 0, 0
    texts = (t for at in range(0, len(column), ROWS) for t in column.slice(at, ROWS).to_pylist())
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size > CHUNK:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))


def _may_reach(a_n: Column, a: Column, b_n: Column, b: Column, threshold: int) -> Column:
    """Whether two sets may reach the threshold, as far as their smallest tokens show. Up to the smaller of their largest shown
    tokens both are shown whole; tokens there that only one has, differ for certain."""
    upto = F.least(F.element_at(a, -1), F.element_at(b, -1))
    shown = lambda x: F.filter(x, lambda t: t <= upto)
    apart = F.size(shown(a)) + F.size(shown(b)) - 2 * F.size(F.array_intersect(shown(a), shown(b)))
    return apart * (100 + threshold) <= (a_n + b_n) * (100 - threshold)


def _sizes_fit(a: Column, b: Column, threshold: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def _filtered(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose text hash may be among ``wanted``: a bitmap of fixed size, made on the executors, known to every task."""
    at = F.pmod("text_hash", F.lit(FILTER_BITS))
    words = (wanted.select(F.floor(at / 63).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(text_hash, {FILTER_BITS}), 63) as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    bits = np.zeros(-(-FILTER_BITS // 63), np.int64)
    found = words.toArrow()  # a row for each word of the bitmap at most
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = slim.sparkSession.sparkContext.broadcast(bits)

    @pandas_udf("boolean")
    def listed(hashes: pd.Series) -> pd.Series:
        place = np.mod(hashes.to_numpy(np.int64), FILTER_BITS)
        return pd.Series((shared.value[place // 63] >> (place % 63)) & 1 == 1)

    return slim.where(listed("text_hash"))


def _texts(slim: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes: the text of one document of each."""
    named = nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "text_hash")
    rows = _filtered(slim, named).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "text")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    return rows.join(named, same).select("node", "text").dropDuplicates(["node"])


def _reaching(threshold: int, width: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (s, t) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = shingle_sets([s.as_py(), t.as_py()], width)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= threshold * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return compare


def _verified(slim: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: int, width: int) -> DataFrame:
    """The links among candidate pairs (a, b) of nodes."""
    shown = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("tokens").alias(f"{c}_tokens"))
    may = _may_reach(F.col("a_n"), F.col("a_tokens"), F.col("b_n"), F.col("b_tokens"), threshold)
    near = pairs.join(shown("a"), "a").join(shown("b"), "b").where(may)
    near = staged(near.select("a", "b"), "near-pairs")
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    texts = staged(_texts(slim, nodes, wanted), "near-texts")
    both = (near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b"))
    return staged(both.select("a", "b", "s", "t").mapInArrow(tidy(_reaching(threshold, width)), "a long, b long"), "links")


def _whole_sets(width: int):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0)
            for at, texts in _portions(batch.column(1)):
                sets = shingle_sets(texts, width)
                flat, offsets = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays(
                    [nodes.slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))],
                    names=["node", "tokens"])

    return sets_of


def _extender(known, threshold: int):
    """Prefixes with the frequent tokens last: the rare tokens that this adds, and how many frequent ones are left. ``whole``: the
    tokens are all of the set, not its smallest alone; where the smallest do not suffice the row is ``short``."""
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = known.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = []
            for node, n, tokens, whole in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "tokens", "whole")), strict=True):
                own = np.array(tokens, np.int64)
                at = np.minimum(np.searchsorted(frequent, own), max(0, len(frequent) - 1))
                often = frequent[at] == own if len(frequent) else np.zeros(len(own), bool)
                length = n - (n * threshold + 99) // 100 + 2
                rare = own[~often][:length]
                short = len(rare) < length and not whole
                added = [] if short else np.setdiff1d(rare, own[:length], assume_unique=True).tolist()
                out.append((node, n, added, 0 if short else min(length - len(rare), int(often.sum())), short))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("node", "n", "added", "left", "short"), r, strict=True)) for r in out], schema=pa.schema([
                    ("node", pa.int64()), ("n", pa.int64()), ("added", pa.list_(pa.int64())), ("left", pa.int64()), ("short", pa.bool_())]))

    return extend


_EXTENDED = "node long, n long, added array<long>, left long, short boolean"


def _extended(slim: DataFrame, nodes: DataFrame, touched: DataFrame, frequent: np.ndarray, threshold: int, width: int) -> DataFrame:
    """(node, n, added, left) of documents whose prefix holds frequent tokens (sorted): the rare tokens that come into it when
    those go last, and how many frequent ones stay in it."""
    known = slim.sparkSession.sparkContext.broadcast(frequent)
    rows = nodes.join(touched, "node", "left_semi").select("node", "n", "tokens", (F.size("tokens") >= F.col("n")).alias("whole"))
    first = staged(rows.mapInArrow(tidy(_extender(known, threshold)), _EXTENDED), "extended")
    short = first.where("short").select("node")
    sets, extend = _whole_sets(width), _extender(known, threshold)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # both in one worker
        for batch in sets(batches):
            n = pa.array(np.diff(np.asarray(batch.column("tokens").offsets)), pa.int64())
            yield from extend([pa.RecordBatch.from_arrays(
                [batch.column("node"), n, batch.column("tokens"), pa.array([True] * len(n))], names=["node", "n", "tokens", "whole"])])

    second = staged(_texts(slim, nodes, short).select("node", "text").mapInArrow(tidy(again), _EXTENDED), "extended-whole")
    return first.where("not short").unionByName(second).drop("short")


def _reach(n: Column, place: Column, threshold: int) -> tuple[Column, Column]:
    """The least and largest size of a set that may reach the threshold with one of ``n`` tokens, if all tokens before
    ``place`` are not shared."""
    least = F.ceil(n * threshold / 100).cast("long")
    return least, (F.floor((n - place) * (100 + threshold) / threshold) - n).cast("long")


def _met(a: str, b: str) -> Column:
    """Whether the sizes of two holders lie in each other's reach."""
    inside = lambda x, y: F.col(f"{y}.n").between(F.col(f"{x}.least"), F.col(f"{x}.most"))
    return inside(a, b) & inside(b, a)


def _ordered(slim: DataFrame, nodes: DataFrame, open_nodes: DataFrame, threshold: int, width: int) -> DataFrame:
    """(node, n, alone, tokens) of some documents: how many of their tokens no other of them has, and the others that stand in
    the prefix, as (holders, token, place), rarest first. Both the counts and the order are over whole sets."""
    texts = _texts(slim, nodes, open_nodes)
    sets = staged(texts.select("node", "text").mapInArrow(tidy(_whole_sets(width)), "node long, tokens array<long>"), "open-sets")
    entries = sets.select("node", F.explode("tokens").alias("token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    found = entries.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("tokens"))
    sized = found.join(nodes.select("node", "n"), "node").withColumn("alone", F.col("n") - F.size("tokens"))
    visible = F.greatest(prefix_length(F.col("n"), threshold) - F.col("alone"), F.lit(0)).cast("int")
    prefix = F.transform(F.slice("tokens", 1, visible), lambda x, i: F.struct(
        x["holders"].alias("holders"), x["token"].alias("token"), (F.col("alone") + i).alias("place")))
    return staged(sized.select("node", "n", "alone", prefix.alias("tokens")).where("size(tokens) > 0"), "ordered")


def _keys(ordered: DataFrame, threshold: int) -> DataFrame:
    """(key, node, n, least, most): each rare token by itself, and each pair of frequent ones, of the extended prefixes; the
    sizes that a partner found by the key may have."""
    def within(rows: DataFrame, place: Column) -> DataFrame:
        least, most = _reach(F.col("n"), place, threshold)
        return rows.select("key", "node", "n", least.alias("least"), most.alias("most")).where("least <= most")

    rare = ordered.select("node", "n", F.explode(F.filter("tokens", lambda x: x["holders"] <= FREQUENT)).alias("x"))
    single = within(rare.withColumn("key", F.xxhash64("x.token")), F.col("x.place"))
    often = ordered.withColumn("often", F.filter("tokens", lambda x: x["holders"] > FREQUENT)).where("size(often) > 1")
    pairs = F.flatten(F.transform("often", lambda x, i: F.transform(F.slice("often", i + 2, F.size("often")), lambda y: F.struct(
        F.xxhash64(x["token"], y["token"]).alias("key"), y["place"].alias("place")))))
    both = often.select("node", "n", F.explode(pairs).alias("x"))
    # of the tokens before the second one only the first is shared
    return single.unionByName(within(both.withColumn("key", F.col("x.key")), F.col("x.place") - 1))


def _candidates(holders: DataFrame) -> DataFrame:
    """Pairs of (key, node, n, least, most, component) that share a key and lie in different components.

    A key's largest component is not paired with itself, so a key costs as many pairs as it has holders of other
    components times all its holders whose sizes fit. Holders are dealt over slots, and the others repeated in each, so no
    task gets all of a key.
    """
    held = holders.groupBy("key", "component").agg(F.count("*").alias("own"))
    main = held.groupBy("key").agg(F.max(F.struct("own", "component")).alias("main"), F.sum("own").alias("of"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("key", F.col("main.component").alias("main"), F.ceil(F.col("of") / SLOT).alias("slots"))
    known = staged(holders.join(main, "key"), "holders")
    others = known.where("component <> main").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    everyone = known.withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")))
    met = others.alias("x").join(everyone.alias("y"), ["key", "slot"]).where(_met("x", "y")).where("x.component <> y.component")
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _direct(holders: DataFrame, threshold: int) -> DataFrame:
    """Pairs between the components of tokens with few holders."""
    side = lambda c: holders.select("token", F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("component").alias(f"{c}_component"))
    met = side("a").join(side("b"), "token").where("a < b and a_component <> b_component")
    return met.where(_sizes_fit(F.col("a_n"), F.col("b_n"), threshold)).select("a", "b").distinct()


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their sketches, nodes (one for each distinct set), and the components of linked nodes."""
    slim = _slim(docs, doc_id, text)
    sketches = staged(slim.mapInArrow(tidy(_sketcher(threshold, width)), _SKETCH), "sketches")
    classes = sketches.where("n > 0")
    labels = classes.groupBy("high", "low").agg(F.min("doc_id").alias("label"))
    single = classes.dropDuplicates(["high", "low"]).join(labels, ["high", "low"])
    nodes = staged(single.withColumn("node", F.monotonically_increasing_id()), "nodes")

    shown = nodes.where("size(tokens) > 0").select("node", "n", F.slice("tokens", 1, prefix_length(F.col("n"), threshold).cast("int")).alias("prefix"))
    entries = shown.select("node", "n", F.explode("prefix").alias("token"))
    several = entries.groupBy("token").agg(F.count("*").alias("holders"), F.min(F.struct("node", "n")).alias("first")).where("holders > 1")
    held = staged(entries.join(several.select("token", "first"), "token"), "held-tokens")
    fit = held.where("node <> first.node").where(_sizes_fit(F.col("n"), F.col("first.n"), threshold))
    stars = staged(fit.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    now = staged(components(_verified(slim, nodes, stars, threshold, width)), "components")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(now, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def of_several(rows: DataFrame) -> DataFrame:
        """Tokens that several components hold, and how many holders they have."""
        sums = placed(rows.select("token", "node")).groupBy("token").agg(
            F.count("*").alias("of"), F.countDistinct("component").alias("components"))
        return sums.where("components > 1")

    open_tokens = staged(of_several(held), "open-tokens")
    rare = staged(held.join(open_tokens, "token", "left_semi").select("token", "node", "n"), "rare-tokens")
    keys, known, extended = open_tokens, np.zeros(0, np.int64), None
    for _ in range(ROUNDS):
        found = keys.where(F.col("components") > FREQUENT).orderBy(F.desc("components"), "token").limit(KNOWN).select("token")
        frequent = staged(found, "frequent-tokens")
        new = frequent.toArrow()["token"].to_numpy()  # KNOWN at most a round
        if not len(new):
            break
        known = np.union1d(known, new)
        touched = staged(rare.join(frequent, "token", "left_semi").select("node").distinct(), "touched")
        again = _extended(slim, nodes, touched, known, threshold, width)
        extended = staged(again if extended is None else extended.join(touched, "node", "left_anti").unionByName(again), "extended-all")
        # rare tokens that extended prefixes add may stand in other prefixes too, and be frequent in their turn
        added = extended.select(F.explode("added").alias("token"), "node", "n")
        others = entries.join(added.select("token").distinct(), "token", "left_semi").select("token", "node", "n")
        kept = rare.join(frequent, "token", "left_anti")
        rare = staged(kept.unionByName(added).unionByName(others).distinct(), "rare-tokens")
        keys = staged(of_several(rare), "rare-keys")
    few = placed(rare.join(keys.where(F.col("of") <= DIRECT).select("token"), "token", "left_semi"))
    direct = staged(_direct(few, threshold).join(stars, ["a", "b"], "left_anti"), "direct-pairs")
    now = staged(merged(now, _verified(slim, nodes, direct, threshold, width)), "components")
    hot = rare.join(keys.where(F.col("of") > DIRECT), "token", "left_semi").select("node")
    left = hot if extended is None else hot.unionByName(extended.where("left > 1").select("node"))
    open_nodes = staged(left.distinct(), "open-nodes")
    if open_nodes.isEmpty():
        return sketches, nodes, now
    # any link not found yet is between two of these, so one order of tokens for them alone is enough
    ordered = _ordered(slim, nodes, open_nodes, threshold, width)
    keyed = placed(ordered.select("node", "n", "alone", F.explode("tokens").alias("x")))
    least, most = _reach(F.col("n"), F.col("x.place"), threshold)
    keyed = staged(keyed.select(F.col("x.token").alias("token"), "node", "n", "alone", "component", least.alias("least"), most.alias("most")), "open-entries")
    # the centre of a token's holders is the one with the fewest tokens of its own: copies are nearest to what they are copies of
    centre = keyed.groupBy("token").agg(F.min(F.struct("alone", "node", "n", "least", "most", "component")).alias("y"))
    near = keyed.select("token", F.struct("node", "n", "least", "most", "component").alias("x")).join(centre, "token")
    near = near.where("x.component <> y.component").where(_met("x", "y"))
    more = staged(near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "centre-pairs")
    now = staged(merged(now, _verified(slim, nodes, more, threshold, width)), "components")
    pairs = _candidates(staged(placed(_keys(ordered, threshold)), "placed-keys"))
    tried = stars.unionByName(direct).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(more)
    pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
    return sketches, nodes, staged(merged(now, _verified(slim, nodes, pairs, threshold, width)), "components")


def near_components(
        docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """A row (doc_id, text_hash, n_shingles, component_id) for each row of ``docs``.

    n_shingles is the size of the text's set of shingles of ``width`` words. component_id is the smallest doc_id that links lead to, links
    joining sets with 100 * intersection >= threshold * union. Null texts, and texts without words, have no shingles and are
    their own component. Rows of equal sets are linked, so repeated rows share a component. Null ids are passed over in
    the minimum unless a component has no others. Other columns are not read. An empty table gives an empty result.
    """
    sketches, nodes, now = _classes(docs, doc_id, text, threshold, width)
    found = now.join(nodes.select("node", "label"), "node")
    least = found.groupBy("component").agg(F.min("label").alias("least"))
    linked = found.join(least, "component").select("node", "least")
    named = nodes.select("high", "low", "node", "label").join(linked, "node", "left").select(
        "high", "low", F.coalesce("least", "label").alias("component_id"))
    slim = sketches.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("high")).alias("high"), F.when(F.col("n") > 0, F.col("low")).alias("low"))
    joined = slim.join(named, ["high", "low"], "left")
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(
        docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns: of the smallest id, then of the smallest text hash. Rows
    without shingles or without an id are all kept."""
    found = near_components(docs, doc_id=doc_id, text=text, threshold=threshold, width=width)
    heads = (found.where("n_shingles > 0 and doc_id is not null").groupBy("component_id")
             .agg(F.min(F.struct("doc_id", "text_hash")).alias("head")).select("head.*"))
    heads = staged(heads, "heads")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"),
        F.regexp_like(body, F.lit(r"[^\x20\x09-\x0D]")).alias("worded"))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64("whole")))
    kept = whole.where("worded and doc_id is not null").join(heads, ["doc_id", "text_hash"], "left_semi").withColumn("first", first).where("first = 1")
    rest = whole.where("not worded or doc_id is null")
    return kept.select("whole.*").unionByName(rest.select("whole.*"))
