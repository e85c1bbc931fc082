"""Review of two snapshots of samples: matching, duplicates, leakage, drift, severity."""

from __future__ import annotations

import heapq
import math
from itertools import combinations, zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.operators import graph
from tributary.operators.graph import beside, discard, materialize, merge_labels, pair_units
from tributary.operators.matching import Matching, strong

RADIUS, DRIFT = 6, 0.1
#: Rows of a bucket aimed at, tables at most, rows of a bucket above which it is split, pairs of a component that one call takes,
#: pairs of small components aimed at in one call.
BUCKET, MAX_TABLES, CAP, ALONE, TOGETHER = 2048, 64, 4096, 500_000, 20_000
DIMENSIONS = ("split", "label", "width", "height", "aspect_ratio", "format", "channels")
# Where sizes and aspect ratios are cut.
SIZES, ASPECTS = (256, 512, 1024), (0.8, 1.25)
# The severity of each code.
SEVERITY = {
    "CROSS_SPLIT_EXACT_LEAKAGE": "error", "EXACT_DUPLICATE_GROUP": "warning", "NEAR_DUPLICATE_GROUP": "warning", "CROSS_SPLIT_NEAR_LEAKAGE": "warning",
    "AMBIGUOUS_MATCH": "warning", "LABEL_DISTRIBUTION_CHANGED": "warning", "MEDIA_DISTRIBUTION_CHANGED": "warning", "SPLIT_CHANGED": "info", "LABEL_CHANGED": "info",
    "SAMPLE_MOVED": "info", "CONTENT_CHANGED": "info", "PROBABLE_REENCODE": "info", "SAMPLE_ADDED": "info", "SAMPLE_REMOVED": "info",
}


def match_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before_path, after_path, confidence) of equal paths: exact where the content is equal too."""
    a, b = before.select("path", F.col("content_hash").alias("_a")), after.select("path", F.col("content_hash").alias("_b"))
    return a.join(b, "path").select(F.col("path").alias("before_path"), F.col("path").alias("after_path"), F.when(F.col("_a") == F.col("_b"), "exact").otherwise("probable").alias("confidence"))


def match_contents(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before_path, after_path): what has no equal path, paired by content in path order."""
    w = Window.partitionBy("content_hash").orderBy("path")
    left = before.join(after.select("path"), "path", "left_anti").withColumn("k", F.row_number().over(w))
    right = after.join(before.select("path"), "path", "left_anti").withColumn("k", F.row_number().over(w))
    return left.select("content_hash", "k", F.col("path").alias("before_path")).join(right.select("content_hash", "k", F.col("path").alias("after_path")), ["content_hash", "k"]).select("before_path", "after_path")


def key_masks(n: int, radius: int) -> list[int]:
    """Bits of 64 that make the keys of each table: rows within radius agree under one of them at least.

    The number of key bits follows the number of rows; where the radius leaves
    too few bits for it, buckets are larger, and split into pairs of blocks.
    """
    need = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
    if not need or radius >= 63:
        return [0]
    best = radius + 1
    for m in range(radius + 1, radius + 6):
        if math.comb(m, radius) > MAX_TABLES:
            break
        best = m
        if (m - radius) * (64 // m) >= need:
            break
    cuts = [64 * k // best for k in range(best + 1)]
    masks = []
    for chosen in combinations(range(best), best - radius):
        bits = [b for row in zip_longest(*(range(cuts[k], cuts[k + 1]) for k in chosen)) for b in row if b is not None][:need]
        masks.append(sum(1 << b for b in bits))
    return masks


def _units(rows: DataFrame, masks: list[int]) -> DataFrame:
    """rows (id, bits, ...) dealt so that any two that agree under a mask meet in one unit of it."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.array(*(F.col("bits").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("band", "key")
    return pair_units(rows.select("*", keys), ["band", "key"], "id", CAP)


def _close(x: np.ndarray, y: np.ndarray, band: int, masks: np.ndarray, radius: int):
    """(rows of x, rows of y, distances) within radius that no table before band brings together."""
    for at in range(0, len(x), 512):
        apart = x[at : at + 512, None] ^ y[None, :]
        distance = np.bitwise_count(apart)
        a, b = np.nonzero(distance <= radius)
        first = ~((apart[a, b][:, None] & masks[None, :band]) == 0).any(axis=1)
        yield at + a[first], b[first], distance[a[first], b[first]]


def near_pairs(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance) of rows (id, bits) within radius, each pair once, where both bits are known.

    Rows that agree in the key bits of a table are compared; a pair comes from
    the first table that has it, so nothing is written twice, and a key of many
    rows is split into blocks.
    """
    side = lambda df, k: df.where("bits is not null").select("id", "bits", F.lit(k).alias("side"))
    rows = side(left, 0).union(side(right, 1))
    kind = rows.schema["id"].dataType.simpleString()
    masks = key_masks(rows.count(), radius)
    table = np.array(masks, np.uint64)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        band, i, j = (int(pdf[c].iloc[0]) for c in ("band", "unit_i", "unit_j"))
        bits, ids = pdf["bits"].to_numpy(np.int64).view(np.uint64), pdf["id"].to_numpy()
        block, of = pdf["block"].to_numpy(), pdf["side"].to_numpy()
        found = []
        for x, y in {(i, j), (j, i)}:
            one, other = np.flatnonzero((of == 0) & (block == x)), np.flatnonzero((of == 1) & (block == y))
            found += [(ids[one[a]], ids[other[b]], d) for a, b, d in _close(bits[one], bits[other], band, table, radius)]
        columns = zip(*found) if found else ([ids[:0]], [ids[:0]], [np.zeros(0, np.int64)])
        a, b, d = (np.concatenate(list(c)) for c in columns)
        return pd.DataFrame({"a": a, "b": b, "distance": d.astype(np.int64)})

    return _units(rows, masks).groupBy("band", "key", "unit_i", "unit_j").applyInPandas(compare, f"a {kind}, b {kind}, distance long")


def near_edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges that span the components of nodes (id, bits, content_hash) within radius and of different content; a unit gives a forest, never all pairs."""
    rows = nodes.where("bits is not null").select("id", "bits", "content_hash")
    kind = rows.schema["id"].dataType.simpleString()
    masks = key_masks(rows.count(), radius)

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        bits, ids, block = pdf["bits"].to_numpy(np.int64).view(np.uint64), pdf["id"].to_numpy(), pdf["block"].to_numpy()
        content = pd.factorize(pdf["content_hash"])[0]
        one, other = (np.flatnonzero(block == pdf[c].iloc[0]) for c in ("unit_i", "unit_j"))
        labels = np.arange(len(pdf))
        for a, b, _ in _close(bits[one], bits[other], 0, np.zeros(0, np.uint64), radius):
            a, b = one[a], other[b]
            apart = content[a] != content[b]
            merge_labels(labels, a[apart], b[apart])
        linked = np.flatnonzero(labels != np.arange(len(pdf)))
        return pd.DataFrame({"a": ids[linked], "b": ids[labels[linked]]})

    return _units(rows, masks).groupBy("band", "key", "unit_i", "unit_j").applyInPandas(forest, f"a {kind}, b {kind}")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, itself where no edge leads on."""
    found = graph.components(edges).withColumnRenamed("node", "_node")
    return nodes.select("node").join(found, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("component"))


def near_components(samples: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, component) of samples (id, content_hash, bits, split) near another of different content.

    Equal contents are one node, so a whole group of copies comes in with its
    first near neighbour; groups of copies alone do not appear.
    """
    nodes = materialize(samples.groupBy("content_hash", "bits").agg(F.min("id").alias("node")), "nodes")
    edges = materialize(near_edges(nodes.select(F.col("node").alias("id"), "bits", "content_hash"), radius), "near")
    touched = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = nodes.join(components(edges, touched), "node")
    return samples.join(found, ["content_hash", "bits"]).select("id", "component")


def _by_component(pairs: DataFrame) -> DataFrame:
    """pairs with component, the connected component of a pair's ends."""
    ends = pairs.select(F.concat(F.lit("a:"), F.col("a").cast("string")).alias("a"), F.concat(F.lit("b:"), F.col("b").cast("string")).alias("b"))
    found = components(ends, ends.select(F.col("a").alias("node")).distinct())
    return pairs.withColumn("_node", F.concat(F.lit("a:"), F.col("a").cast("string"))).join(found, F.col("_node") == F.col("node")).drop("_node", "node")


def greedy_match(pairs: DataFrame, alone: int = ALONE) -> DataFrame:
    """(a, b, distance): best pairs first by (distance, a, b), each side used once.

    Components of up to alone pairs are sorted and taken in one call each.
    Larger ones go by rounds of mutual best, which give the same pairs; each
    round's pairs are written, so the plan never grows.
    """
    pairs = materialize(_by_component(pairs.select("a", "b", "distance")), "pairs")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = f"a {kinds['a']}, b {kinds['b']}, distance {kinds['distance']}"
    sizes = pairs.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > alone).select("component")
    large = beside(materialize(sizes, "large"))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, rows = set(), set(), []
        for r in pdf.sort_values(["distance", "a", "b"], kind="stable")[["a", "b", "distance"]].itertuples(index=False):
            if r.a not in used_a and r.b not in used_b:
                used_a.add(r.a)
                used_b.add(r.b)
                rows.append(r)
        return pd.DataFrame(rows, columns=["a", "b", "distance"])

    out = pairs.join(large, "component", "left_anti").groupBy("component").applyInPandas(take, schema)
    order = F.struct("distance", "a", "b")
    left = materialize(pairs.join(large, "component").select("a", "b", "distance"), "left")
    while not left.isEmpty():
        best = left.withColumn("ra", F.row_number().over(Window.partitionBy("a").orderBy(order))).withColumn("rb", F.row_number().over(Window.partitionBy("b").orderBy(order))).where("ra = 1 and rb = 1").select("a", "b", "distance")
        best = materialize(best, "best")
        out = out.union(best)
        before, left = left, materialize(left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti"), "left")
        discard(before)
    return out


def assign_component(costs: dict[tuple, int]) -> list[tuple]:
    """Pairs of most matches, then least total cost, of one component."""
    return assignment(costs)[0]


def assignment(costs: dict[tuple, int]) -> tuple[list[tuple], set[tuple]]:
    """(pairs, those of them that another matching of the same size and cost goes without).

    Shortest augmenting paths with potentials give the pairs: for n of one side
    and e costs, n searches of e log e steps. A pair is dispensable where its
    ends lie on a cycle of the residual graph without cost, that is, in one
    strongly connected component of its tight edges; the source and the sink
    stand for what is left unmatched.
    """
    lefts, rights = sorted({a for a, _ in costs}), sorted({b for _, b in costs})
    source, sink = 0, len(lefts) + len(rights) + 1
    at_a, at_b = {a: k for k, a in enumerate(lefts, 1)}, {b: k for k, b in enumerate(rights, len(lefts) + 1)}
    open_: list[dict[int, int]] = [{} for _ in range(sink + 1)]  # residual edges and their costs
    for a in lefts:
        open_[source][at_a[a]] = 0
    for b in rights:
        open_[at_b[b]][sink] = 0
    for (a, b), c in sorted(costs.items()):
        open_[at_a[a]][at_b[b]] = c
    level = [0] * (sink + 1)  # potentials: an open edge from x to y costs c + level[x] - level[y], 0 or more
    while True:
        reach, back, heap = {source: 0}, {}, [(0, source)]
        done: set[int] = set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            if x == sink:
                break
            for y, c in open_[x].items():
                e = d + c + level[x] - level[y]
                if y not in done and e < reach.get(y, e + 1):
                    reach[y], back[y] = e, x
                    heapq.heappush(heap, (e, y))
        if sink not in done:
            break
        far = reach[sink]
        for x in range(sink + 1):
            level[x] += min(reach.get(x, far), far)
        y = sink
        while y != source:
            x = back[y]
            open_[y][x] = -open_[x].pop(y)
            y = x
    pairs = []
    for b in rights:
        for x in open_[at_b[b]]:
            if 0 < x <= len(lefts):
                pairs.append((lefts[x - 1], b))
    tight = [[y for y, c in open_[x].items() if c + level[x] - level[y] == 0] for x in range(sink + 1)]
    part = strong(tight)
    return sorted(pairs), {(a, b) for a, b in pairs if part[at_a[a]] == part[at_b[b]]}


def optimal_match(pairs: DataFrame, ambiguity: bool = True, together: int = TOGETHER) -> DataFrame:
    """(a, b, distance, ambiguous): matching of most pairs, then of least distance in all, of each connected component.

    A pair is ambiguous where forbidding it leaves a matching of the same size
    and cost, which the residual graph tells without solving again. A pair given
    several times counts with its least distance. A component is solved in one
    call, small ones by the many: calls follow the pairs, not the components,
    and what is chosen in one never depends on its company.
    """
    pairs = materialize(pairs.select("a", "b", F.col("distance").cast("long").alias("distance")), "pairs")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    calls = math.ceil(pairs.count() / together) or 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b", "distance"], kind="stable").drop_duplicates(["a", "b"])
        distance = pdf["distance"].to_numpy(np.int64)
        found = Matching(pd.factorize(pdf["a"])[0], pd.factorize(pdf["b"], sort=True)[0], distance)
        best = found.chosen()
        loose = found.loose() if ambiguity else np.zeros(len(best), bool)
        return pd.DataFrame({"a": pdf["a"].to_numpy()[best], "b": pdf["b"].to_numpy()[best], "distance": distance[best], "ambiguous": loose})

    dealt = _by_component(pairs).withColumn("call", F.pmod(F.xxhash64("component"), F.lit(calls)))
    return dealt.groupBy("call").applyInPandas(solve, f"a {kinds['a']}, b {kinds['b']}, distance long, ambiguous boolean")


def exact_groups(samples: DataFrame) -> DataFrame:
    """(content_hash, members, splits, code): groups of equal content, leakage where they span splits."""
    groups = samples.groupBy("content_hash").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("split").alias("splits")).where("members > 1")
    codes = F.array_compact(F.array(F.lit("EXACT_DUPLICATE_GROUP"), F.when(F.col("splits") > 1, "CROSS_SPLIT_EXACT_LEAKAGE")))
    return groups.select("content_hash", "members", "splits", F.explode(codes).alias("code"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before_path, after_path, code): what differs between samples matched by path, then by content, and what only one side has."""
    found = match_paths(before, after).select("before_path", "after_path").union(match_contents(before, after)).alias("m")
    both = found.join(before.alias("a"), F.col("m.before_path") == F.col("a.path"), "full_outer").join(after.alias("b"), F.col("m.after_path") == F.col("b.path"), "full_outer")
    here = F.col("a.path").isNotNull() & F.col("b.path").isNotNull()
    code = F.array_compact(F.array(
        F.when(F.col("a.path").isNull(), "SAMPLE_ADDED"), F.when(F.col("b.path").isNull(), "SAMPLE_REMOVED"),
        F.when(here & ~F.col("a.split").eqNullSafe(F.col("b.split")), "SPLIT_CHANGED"), F.when(here & ~F.col("a.label").eqNullSafe(F.col("b.label")), "LABEL_CHANGED"),
        F.when(here & (F.col("a.path") != F.col("b.path")), "SAMPLE_MOVED"), F.when(here & (F.col("a.content_hash") != F.col("b.content_hash")), "CONTENT_CHANGED"),
    ))
    return both.select(F.col("a.path").alias("before_path"), F.col("b.path").alias("after_path"), F.explode(code).alias("code"))


def match_samples(before: DataFrame, after: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(before_path, after_path, method, distance, confidence, members) by path, then content, then perceptual hash.

    Samples are (path, content_hash, label, split) with an optional 64-bit hash,
    bits. What is left of both sides is matched within radius, each connected
    component at least total distance; where another assignment costs the same,
    all its pairs are ambiguous and members are the paths of the component.
    """
    a, b = (x if "bits" in x.columns else x.withColumn("bits", F.lit(None).cast("long")) for x in (before, after))
    none = F.lit(None).cast("array<string>")
    distance = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))).cast("long")
    bits = a.select(F.col("path").alias("before_path"), F.col("bits").alias("a_bits")).join(b.select(F.col("path").alias("before_path"), F.col("bits").alias("b_bits")), "before_path")
    paths = match_paths(a, b).join(bits, "before_path").select("before_path", "after_path", F.lit("path").alias("method"), distance.alias("distance"), "confidence", none.alias("members"))
    same = match_contents(a, b).select("before_path", "after_path", F.lit("content").alias("method"), F.lit(0).cast("long").alias("distance"), F.lit("exact").alias("confidence"), none.alias("members"))
    found = materialize(paths.union(same), "matches")
    left = a.join(found.select(F.col("before_path").alias("path")), "path", "left_anti").select(F.col("path").alias("id"), "bits")
    right = b.join(found.select(F.col("after_path").alias("path")), "path", "left_anti").select(F.col("path").alias("id"), "bits")
    pairs = materialize(near_pairs(left, right, radius), "pairs")
    if pairs.isEmpty():
        return found
    grouped = _by_component(pairs)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        costs = {(x, y): int(d) for x, y, d in zip(pdf["a"], pdf["b"], pdf["distance"])}
        lefts, rights = sorted({x for x, _ in costs}), sorted({y for _, y in costs})
        if len(costs) == len(lefts) * len(rights) and len(set(costs.values())) == 1:
            chosen = list(zip(lefts, rights))
            ambiguous = len(chosen) > 1
        else:
            # ties go to the first places, without ever outweighing a distance
            weight = (len(lefts) * len(rights) + 1) * (min(len(lefts), len(rights)) + 1)
            row, column = ({x: k for k, x in enumerate(side)} for side in (lefts, rights))
            chosen = assign_component({(x, y): d * weight + row[x] * len(rights) + column[y] for (x, y), d in costs.items()})
            ambiguous = bool(assignment(costs)[1])
        members = sorted([*lefts, *rights]) if ambiguous else None
        return pd.DataFrame([(*p, "perceptual", costs[p], "ambiguous" if ambiguous else "probable", members) for p in chosen], columns=["before_path", "after_path", "method", "distance", "confidence", "members"])

    return found.union(grouped.groupBy("component").applyInPandas(solve, "before_path string, after_path string, method string, distance long, confidence string, members array<string>"))


def sample_findings(before: DataFrame, after: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(code, sample_ids, distance): what changed between two snapshots, by all matches of match_samples; ambiguous pairs tell no change."""
    matches = materialize(match_samples(before, after, radius), "matches")
    sure = matches.where("confidence <> 'ambiguous'").alias("m").join(before.alias("a"), F.col("m.before_path") == F.col("a.path")).join(after.alias("b"), F.col("m.after_path") == F.col("b.path"))
    near = F.coalesce(F.col("m.distance") <= radius, F.lit(False))
    other = F.col("a.content_hash") != F.col("b.content_hash")
    codes = F.array_compact(F.array(
        F.when(~F.col("a.split").eqNullSafe(F.col("b.split")), "SPLIT_CHANGED"), F.when(~F.col("a.label").eqNullSafe(F.col("b.label")), "LABEL_CHANGED"),
        F.when(F.col("a.path") != F.col("b.path"), "SAMPLE_MOVED"), F.when(other & near, "PROBABLE_REENCODE"), F.when(other & ~near, "CONTENT_CHANGED"),
    ))
    found = sure.select(F.explode(codes).alias("code"), F.array("m.before_path", "m.after_path").alias("sample_ids"), F.col("m.distance").alias("distance"))
    found = found.withColumn("distance", F.when(F.col("code").isin("PROBABLE_REENCODE", "CONTENT_CHANGED"), F.col("distance")))
    unsure = matches.where("confidence = 'ambiguous'").groupBy("members").agg(F.sum("distance").alias("distance")).select(F.lit("AMBIGUOUS_MATCH").alias("code"), F.col("members").alias("sample_ids"), "distance")
    one = lambda x, side, code: x.join(matches.select(F.col(side).alias("path")), "path", "left_anti").select(F.lit(code).alias("code"), F.array("path").alias("sample_ids"), F.lit(None).cast("long").alias("distance"))
    return found.union(unsure).union(one(after, "after_path", "SAMPLE_ADDED")).union(one(before, "before_path", "SAMPLE_REMOVED"))


def near_groups(samples: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(component, members, splits, code): groups of near_components, leakage where they span splits."""
    groups = near_components(samples, radius).join(samples.select("id", "split"), "id").groupBy("component")
    groups = groups.agg(F.count(F.lit(1)).alias("members"), (F.count_distinct("split") + F.max(F.col("split").isNull().cast("int"))).alias("splits"))
    codes = F.array_compact(F.array(F.lit("NEAR_DUPLICATE_GROUP"), F.when(F.col("splits") > 1, "CROSS_SPLIT_NEAR_LEAKAGE")))
    return groups.select("component", "members", "splits", F.explode(codes).alias("code"))


def in_buckets(samples: DataFrame) -> DataFrame:
    """Samples with the seven dimensions of a distribution: width, height and their ratio cut into buckets, unknown where not known."""
    a, b, c = SIZES

    def size(name: str):
        v = F.col(name)
        return F.when(v.isNull(), "unknown").when(v < a, f"<{a}").when(v < b, f"{a}-{b - 1}").when(v < c, f"{b}-{c - 1}").otherwise(f">={c}")

    ratio = F.col("width") / F.nullif(F.col("height"), F.lit(0))
    aspect = F.when(ratio.isNull(), "unknown").when(ratio < ASPECTS[0], "portrait").when(ratio <= ASPECTS[1], "square").otherwise("landscape")
    return samples.select("split", "label", size("width").alias("width"), size("height").alias("height"), aspect.alias("aspect_ratio"), F.coalesce("media_format", F.lit("unknown")).alias("format"), F.coalesce(F.col("channels").cast("string"), F.lit("unknown")).alias("channels"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: added, removed, replaced, moved of manifests (path, size, content_hash); files gone and come with one content are moves."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    same = (F.col("a.content_hash") == F.col("b.content_hash")) & (F.col("a.size") == F.col("b.size"))
    state = F.when(F.col("a.path").isNull(), "come").when(F.col("b.path").isNull(), "gone").when(~same, "replaced")
    rows = both.select(state.alias("state"), F.coalesce("a.content_hash", "b.content_hash").alias("h"), F.coalesce("a.size", "b.size").alias("s")).where("state is not null")
    per = rows.groupBy("h", "s").agg(*(F.count_if(F.col("state") == x).alias(x) for x in ("come", "gone", "replaced"))).withColumn("moved", F.least("come", "gone"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return per.agg(total(F.col("come") - F.col("moved"), "added"), total(F.col("gone") - F.col("moved"), "removed"), total(F.col("replaced"), "replaced"), total(F.col("moved"), "moved"))


def distribution(samples: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(dimension, key, n, share): all histograms in one aggregation."""
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("key")) for d in dimensions))
    counts = samples.select(F.explode(cells).alias("x")).groupBy("x.dimension", "x.key").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def drift(before: DataFrame, after: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(dimension, key, before_n, after_n, share_change, relative_change); the last is null where there was none before."""
    a, b = (distribution(x, dimensions).alias(n) for x, n in ((before, "a"), (after, "b")))
    on = (F.col("a.dimension") == F.col("b.dimension")) & (F.col("a.key") == F.col("b.key"))
    zero = F.lit(0)
    n0, n1 = F.coalesce("a.n", zero), F.coalesce("b.n", zero)
    return a.join(b, on, "full_outer").select(
        F.coalesce("a.dimension", "b.dimension").alias("dimension"), F.coalesce("a.key", "b.key").alias("key"), n0.alias("before_n"), n1.alias("after_n"),
        (F.coalesce("b.share", F.lit(0.0)) - F.coalesce("a.share", F.lit(0.0))).alias("share_change"), F.when(n0 > 0, (n1 - n0) / n0).alias("relative_change"),
    )


def drift_findings(deltas: DataFrame, least: float = DRIFT) -> DataFrame:
    """(code, dimension, key, share_change) where a share moved by least or more."""
    code = F.when(F.col("dimension") == "label", "LABEL_DISTRIBUTION_CHANGED").otherwise("MEDIA_DISTRIBUTION_CHANGED")
    return deltas.where(F.abs("share_change") >= least).select(code.alias("code"), "dimension", "key", "share_change")


def status(findings: DataFrame, overrides: dict[str, str] | None = None, complete: bool = True) -> DataFrame:
    """(status): incomplete before fail before warn before pass, by the severity of the codes found."""
    table = SEVERITY | (overrides or {})
    rank = F.create_map(*(x for c, s in table.items() for x in (F.lit(c), F.lit({"error": 2, "warning": 1}.get(s, 0)))))
    worst = F.coalesce(F.max(F.coalesce(F.try_element_at(rank, F.col("code")), F.lit(0))), F.lit(0))
    return findings.agg((F.lit("incomplete") if not complete else F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass")).alias("status"))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, old_path, change) of manifests (path, size, content_hash): unchanged, modified, renamed, removed, added."""
    a, b = before.alias("a"), after.alias("b")
    same = a.join(b, F.col("a.path") == F.col("b.path")).select(F.col("b.path").alias("path"), F.lit(None).cast("string").alias("old_path"), F.when(F.col("a.content_hash") == F.col("b.content_hash"), "unchanged").otherwise("modified").alias("change"))
    w = Window.partitionBy("content_hash", "size").orderBy("path")
    gone = before.join(after.select("path"), "path", "left_anti").withColumn("k", F.row_number().over(w)).withColumnRenamed("path", "old_path")
    come = after.join(before.select("path"), "path", "left_anti").withColumn("k", F.row_number().over(w))
    moved = gone.join(come, ["content_hash", "size", "k"], "full_outer")
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("path").isNull(), "removed").otherwise("renamed")
    rest = moved.select(F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"), change.alias("change"))
    return same.union(rest)
