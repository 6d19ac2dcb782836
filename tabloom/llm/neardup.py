"""Near-duplicates by improved consistent weighted sampling over TF-IDF weighted 5-word shingles.

A text's shingles are runs of 5 lower-cased words; a shingle's weight is its count in the text times an inverse
document frequency.  Weighted Jaccard similarity (sum of minima over sum of maxima) of SIMILARITY or more is a link;
classes are the connected components of links and equal texts.

1. Equal texts are one node (128-bit digest), so copies never meet each other again.
2. Document frequencies are kept in a table of CELLS cells, of fixed size at any scale.  A family (texts with the same
   least shingle hash, as near copies mostly have) counts as one document, else the shingles of a much copied text would
   pass for common ones; the share of a cell that its many rare shingles explain is taken off.  The weight is
   ``min(1, ln(1 + N/df) / ln(1 + RARE))``: only shingles in more than 1/RARE of the families lose weight.
3. Improved consistent weighted sampling draws BANDS * ROWS samples; two texts agree on a sample with a probability
   equal to their similarity.  Gamma variates are looked up in quantile tables made by rule.  Texts that agree on
   all rows of a band share a bucket; at similarity 0.8 a pair misses every bucket with probability 0.003.
4. Small groups.  A bucket of up to SMALL members is sent with its texts to one place, once where several buckets have the
   same members, and all its pairs are compared there; what comes out is a spanning forest and no pair.
5. Large groups.  Larger buckets that share members are one cluster, and clusters are disjoint.  Let the core
   be CORE members of its most numerous class, those of most buckets (in later rounds, most like T of the round before), and
   T what at least two of the core share (nearly all that the cluster has in common).  The hub is the core's member most like
   T, and every member of another class is compared with it.  Let y be like x,
   where x isn't linked to the hub.  Either x and y share shingles outside T: then one of the rarest such shingles
   of each, up to a weight of 1 - SIMILARITY of its own.  Or all that they share is in T: then y's weight lies between
   SIMILARITY of x's and what the weight that x has in T allows.  Every member is put once into new groups by those
   rarest shingles (a fifth of its own at most) and by its class of weight, where members without a link to the hub look
   for it.  In a class of weight, where one side (who is looked for, or who looks) has at most FEW members, all of the other
   are compared with them; other new groups go through 4 and 5 again.
6. The end.  From the second round on, a cluster has TEAM pivots, twice as many each round; they are compared with
   all members in other classes and leave the search, since nothing of theirs is open.  So every round shrinks every
   cluster, the number of rounds grows with the logarithm of the largest, no pair of a bucket is lost, and no round is one of
   all pairs.

Defined results: a null text is a class of its own; texts without a word are alike only if equal; equal texts, ties and
repeated rows share a class; the class id is the class's least doc_id (null only if all are); an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import hashing
from tabloom.llm.common import bucketed, checkpoint, turn, written
from tabloom.llm.components import PART, components

SIMILARITY = 0.8
BANDS, ROWS = 8, 3
SAMPLES = BANDS * ROWS
SMALL = 192
TEAM = 8
CORE = 32
FEW = 32
#: Members of a large cluster that are compared with one copy of the hub's text.
SHARE = 512
#: Numbers of a block of the table by which a small group is compared.
BLOCK = 1 << 20
#: Classes of weight differ by this factor.
STEP = 1.01
#: What a key says: a shingle, or a class of weight that holds a member or is looked for by one.
SHINGLE_KEY, HOLDS, SEEKS = 0, 1, 2
CELLS = 1 << 17
RARE = 100
SCALE = 1 << 20
SEEDS = hashing.numbers(SAMPLES, 2)


@lru_cache(maxsize=1)
def _gamma() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of 65,536 equal shares, by bisection."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < share
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return high


@lru_cache(maxsize=1)
def _log_gamma() -> np.ndarray:
    return np.log(_gamma())


def samples(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES consistent samples of a weighted set (distinct keys, weights over 0)."""
    best, found = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, np.uint64)
    r_of, c_of = _gamma(), _log_gamma()
    for at in range(0, len(keys), 4096):
        part = keys[at : at + 4096]
        m = hashing.mix(part[:, None] ^ SEEDS)
        r = r_of[m & np.uint64(0xFFFF)]
        share = ((m >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.float64) + 0.5) / (1 << 16)
        t = np.floor(np.log(weights[at : at + 4096])[:, None] / r + share)
        score = c_of[m >> np.uint64(48)] - r * (t - share + 1)
        row = score.argmin(0)
        least = score[row, range(SAMPLES)]
        better = least < best
        chosen = hashing.mix(part[row] + t[row, range(SAMPLES)].astype(np.int64).view(np.uint64) * np.uint64(hashing.GOLDEN))
        best, found = np.where(better, least, best), np.where(better, chosen, found)
    return found


def cells(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(47)).astype(np.int64)


def counted(text_shingles: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and their weights."""
    keys, n = np.unique(text_shingles, return_counts=True)
    return keys, n * idf[cells(keys)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets; 0 with an empty one."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total > 0 else 0.0


def _bytes(text: str) -> bytes:
    return text.lower().encode()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Groups of (key, bytes of the lower-cased text) of batches with a key and a text."""
    turn()
    return hashing.groups((k, _bytes(t)) for batch in batches for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))


def compact(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The frame, checkpointed, in as many partitions as its rows need, however many the session deals out, and the number of its rows.
    It has at most ``most`` rows: a partition is a file, which an executor makes with processes of its own, so it gets no more of them than those need."""
    df = checkpoint(df.coalesce(1 + most // PART))
    n = df.count()
    return df.coalesce(1 + n // PART), n


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, text, node): the node is the digest of a text, null for a null text."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("node", F.unhex(F.md5("text")))


def families(rows: DataFrame) -> np.ndarray:
    """How many texts have their least shingle hash in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for group in _grouped(batches):
            for keys in hashing.shingles([g[1] for g in group]):
                if len(keys):
                    total[cells(keys.min(keepdims=True))] += 1
        yield _sparse(total)

    return _dense(rows.select("node", "text").mapInArrow(run, "cell int, n long"))


def frequencies(rows: DataFrame, family: np.ndarray) -> np.ndarray:
    """The families that hold each cell's shingles, in 1/SCALE."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(np.rint(SCALE / np.maximum(family, 1)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, total = shared.value, np.zeros(CELLS, np.int64)
        for group in _grouped(batches):
            for keys in hashing.shingles([g[1] for g in group]):
                if len(keys):
                    np.add.at(total, cells(np.unique(keys)), share[cells(keys.min(keepdims=True))])
        yield _sparse(total)

    return _dense(rows.select("node", "text").mapInArrow(run, "cell int, n long"))


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["cell", "n"])


def _dense(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' tables: at most CELLS rows reach the driver."""
    found = parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(CELLS, np.int64)
    total[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return total


def idf_table(rows: DataFrame) -> np.ndarray:
    """The weight of a shingle by its cell."""
    family = families(rows)
    n = np.count_nonzero(family)
    df = frequencies(rows, family) / SCALE
    df = np.maximum(df - df.mean(), 1.0)
    return np.minimum(1.0, np.log1p(max(n, 1) / df) / np.log1p(RARE)).astype(np.float32)


def sketches(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, buckets): a number a band for every node whose text has a word."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.astype(np.float64)
        for group in _grouped(batches):
            keys, bucket = [], []
            for (node, _), found in zip(group, hashing.shingles([g[1] for g in group])):
                if len(found):
                    drawn = samples(*counted(found, weights))
                    keys.append(node)
                    bucket.append(hashing.mix((drawn.reshape(BANDS, ROWS) * hashing.STEPS[:ROWS]).sum(1)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bucket, pa.list_(pa.int64()))], ["node", "buckets"])

    drawn = rows.select("node", "text").mapInArrow(run, "node binary, buckets array<long>")
    return drawn.groupBy("node").agg(F.first("buckets").alias("buckets"))


def outside(x: tuple[np.ndarray, np.ndarray], team: tuple[np.ndarray, np.ndarray], idf: np.ndarray, name: bytes, linked: bool) -> tuple[list[int], list[int]]:
    """The keys of the groups in which x meets all that are like it where not both are linked to the hub of that name, and
    what each says; ``team`` may be any weighted set."""
    keys, weights = x
    shared = np.zeros(len(keys))
    if len(team[0]):
        at = np.clip(np.searchsorted(team[0], keys), 0, len(team[0]) - 1)
        shared = np.where(team[0][at] == keys, np.minimum(weights, team[1][at]), 0.0)
    total, common, rest = weights.sum(), shared.sum(), weights - shared
    own = np.flatnonzero(rest > 0)
    order = own[np.lexsort((keys[own], -idf[cells(keys[own])]))]
    enough = int(np.searchsorted(np.cumsum(rest[order]), (1 - SIMILARITY) * total * (1 - 1e-6), "right")) + 1
    found = keys[order[:enough]].view(np.int64).tolist()
    says = [SHINGLE_KEY] * len(found)
    step = lambda w: int(np.floor(np.log(w) / np.log(STEP)))
    low, high = SIMILARITY * total * (1 - 1e-6), (common / SIMILARITY + common - total) * (1 + 1e-6)
    classes = [(step(total), HOLDS)] if high >= low else []
    if not linked and high >= low:
        classes += [(k, SEEKS) for k in range(step(low), step(high) + 1)]
    of_hub = int.from_bytes(name[:8], "little")
    marks = np.array([(of_hub + (k + 100_000) * hashing.GOLDEN) & hashing.MASK for k, _ in classes], np.uint64)
    return found + hashing.mix(marks).view(np.int64).tolist(), says + [role for _, role in classes]


def forest(sets: list[tuple[np.ndarray, np.ndarray]], labels: list) -> list[tuple[int, int]]:
    """Links (i, j) of similar sets that join classes which neither the labels nor the links before join."""
    parent = [labels.index(label) for label in labels]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    n, links = len(sets), []
    total = np.array([w.sum() for _, w in sets])
    _, where, held = np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True, return_counts=True)
    column = np.cumsum(held > 1) - 1  # of the shingles that two or more hold
    ends = np.cumsum([len(k) for k, _ in sets])
    width, shared = int(column[-1]) + 1, np.zeros((n, n))
    step = max(1, BLOCK // n)
    for low in range(0, width, step):
        part = np.zeros((n, min(step, width - low)))
        for i, (_, weights) in enumerate(sets):
            own = where[ends[i] - len(weights) : ends[i]]
            inside = (held[own] > 1) & (column[own] >= low) & (column[own] < low + part.shape[1])
            part[i, column[own[inside]] - low] = weights[inside]
        for i in range(n - 1):
            shared[i, i + 1 :] += np.minimum(part[i], part[i + 1 :]).sum(1)
    alike = shared >= SIMILARITY * (total[:, None] + total - shared)
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike, 1)))):
        if root(i) != root(j):
            parent[root(j)] = root(i)
            links.append((i, j))
    return links


def within(members: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(a, b): links that join the classes of each group's (gid, node, label); a group holds at most SMALL."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    dealt = members.join(texts, "node").select("gid", "node", "label", "text").repartition("gid").sortWithinPartitions("gid", "node")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[tuple]]]:
        """Whole groups, some at a time."""
        turn()
        done, last, size = [], None, 0
        for batch in batches:
            for gid, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if gid != last:
                    if size >= hashing.GROUP_BYTES:
                        yield done
                        done, size = [], 0
                    done.append([])
                    last = gid
                data = _bytes(rest[2])
                done[-1].append((rest[0], rest[1], data))
                size += len(data)
        if done:
            yield done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.astype(np.float64)
        for groups in gathered(batches):
            found = hashing.shingles([m[2] for g in groups for m in g])
            links = []
            for group in groups:
                sets = [counted(next(found), weights) for _ in group]
                links += [(group[i][0], group[j][0]) for i, j in forest(sets, [m[1] for m in group])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def teams(chosen: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(cluster, hub, team_keys, team_weights): the shingles that two or more of a cluster's at most CORE chosen members hold,
    and the member most like them."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    held = chosen.join(texts, "node").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("node", "text"))).alias("core"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.astype(np.float64)
        for batch in batches:
            hubs, keys, values = [], [], []
            for core in batch.column(1).to_pylist():
                sets = [counted(next(hashing.shingles([_bytes(m["text"])])), weights) for m in core]
                every, where, held = np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True, return_counts=True)
                most = np.zeros(len(every))
                np.maximum.at(most, where, np.concatenate([w for _, w in sets]))
                keys.append(every[held > 1].view(np.int64).tolist())
                values.append(most[held > 1].tolist())
                near = [similarity(own, (every[held > 1], most[held > 1])) for own in sets]
                hubs.append(core[int(np.argmax(near))]["node"])
            arrays = [batch.column(0), pa.array(hubs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["cluster", "hub", "team_keys", "team_weights"])

    return held.mapInArrow(run, "cluster binary, hub binary, team_keys array<long>, team_weights array<double>")


def compared(pairs: DataFrame, team: DataFrame | None, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(a, b, linked, keys, says, near) of pairs (cluster, a, salt, b, hub, ask, same): whether the texts of a and b are similar,
    unless both are of the same class; where ``ask``, the keys that
    :func:`outside` gives for b and its similarity to the shared shingles.  The text of a and the cluster's shared shingles are sent once for
    each (a, salt), ahead of its members."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    heads = pairs.groupBy("cluster", "a", "salt").agg(F.max("hub").alias("hub"))
    none = [F.lit(None).cast("array<long>").alias("team_keys"), F.lit(None).cast("array<double>").alias("team_weights")]
    if team is None:
        heads = heads.join(texts.withColumnRenamed("node", "a"), "a").select("*", *none)
    else:
        about = heads.where("hub").select("cluster", "a").distinct().join(team.drop("hub"), "cluster").select("a", "team_keys", "team_weights")
        heads = heads.join(texts.withColumnRenamed("node", "a"), "a").join(about, "a", "left")
    heads = heads.select("a", "salt", F.lit(None).cast("binary").alias("b"), F.lit(False).alias("ask"), F.lit(False).alias("same"), "text", "team_keys", "team_weights")
    members = pairs.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "ask", "same", "text", *none)
    dealt = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn()
        weights = shared.value.astype(np.float64)
        hub = team = None
        for batch in batches:
            names, others = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            asked, same, cut = (batch.column(i).to_pylist() for i in (3, 4, 5))
            rows: list[tuple] = []
            at = 0
            for group in hashing.groups(((None, _bytes(t)) for t in cut)):
                for found in hashing.shingles([g[1] for g in group]):
                    own = counted(found, weights)
                    if others[at] is None:
                        hub = own
                        team = (np.array(batch.column(6)[at].as_py() or [], np.int64).view(np.uint64), np.array(batch.column(7)[at].as_py() or [], np.float64))
                    else:
                        linked = same[at] or similarity(hub, own) >= SIMILARITY
                        keys, says = outside(own, team, weights, names[at], linked) if asked[at] else ([], [])
                        if linked or keys:
                            rows.append((names[at], others[at], linked and not same[at], keys, says, similarity(own, team) if keys else 0.0))
                    at += 1
            kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["a", "b", "linked", "keys", "says", "near"])

    return dealt.mapInArrow(run, "a binary, b binary, linked boolean, keys array<long>, says array<tinyint>, near double")


def clusters(large: DataFrame, n_large: int, level: int, texts: DataFrame, idf: np.ndarray) -> tuple[DataFrame, DataFrame, int]:
    """What :func:`teams` gives, the pairs (cluster, a, salt, b, hub, ask, same) that a round looks at, and how many they are at most,
    for n_large rows of large groups (gid, node, label, near)."""
    least = large.groupBy("gid").agg(F.min("node").alias("a"))
    known = components(large.join(least, "gid").select("a", F.col("node").alias("b")), n_large)
    held = large.groupBy("node", "label").agg(F.count("*").alias("support"), F.max("near").alias("near"))
    members, n_members = compact(held.join(known.withColumnRenamed("label", "cluster"), "node"), n_large)
    sizes = members.groupBy("cluster", "label").agg(F.count("*").alias("k"))
    most = sizes.groupBy("cluster").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("most"))
    n_pivots = TEAM << (level - 1) if level else 1
    ranked = members.join(most, "cluster").withColumn("main", F.col("label") == F.col("most.label"))
    first = Window.partitionBy("cluster").orderBy(F.desc("main"), F.desc("near"), F.desc("support"), "node")
    top, n_top = compact(ranked.select("cluster", "node", "label", "near", "support", "n", "main").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max(n_pivots, CORE)), n_members)
    team = written(teams(top.where(F.col("rank") <= CORE).select("cluster", "node"), texts, idf), "teams")
    placed = top.join(team.select("cluster", "hub"), "cluster").withColumn("rank", F.when(F.col("node") == F.col("hub"), 0).otherwise(F.col("rank")))
    pivots, _ = compact(placed.where(F.col("rank") < n_pivots).drop("hub"), n_top)
    others = members.join(pivots.select("node", "rank"), "node", "left").select("cluster", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("rank").alias("rank_b"))
    sides = pivots.select("cluster", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("rank").alias("rank_a"), "n")
    same, hub = F.col("label_a") == F.col("label_b"), F.col("rank_a") == 0
    ask = hub & F.col("rank_b").isNull()
    new = F.col("rank_b").isNull() | (F.col("rank_b") > F.col("rank_a"))
    pairs = others.join(sides, "cluster").where(new & (ask | ~same))
    return team, pairs.select("cluster", "a", _salt(), "b", hub.alias("hub"), ask.alias("ask"), same.alias("same")), n_members * n_pivots


def _salt() -> Column:
    """The part, of SHARE members or so, in which b is compared with one of n members' hub or pivot."""
    return F.pmod(F.xxhash64("b"), 1 + F.floor(F.col("n") / SHARE)).cast("long").alias("salt")


def sided(keyed: DataFrame, kinds: DataFrame) -> DataFrame:
    """The pairs, as :func:`clusters` gives them, of classes of weight (in kinds) of which one side has at most FEW members."""
    few = kinds.where(F.least("holds", "seeks") <= FEW).select("gid", F.when(F.col("holds") <= F.col("seeks"), HOLDS).otherwise(SEEKS).alias("side"), (F.col("holds") + F.col("seeks")).alias("n"))
    members = keyed.join(few, "gid")
    one = members.where(F.col("says") == F.col("side")).select("gid", F.col("node").alias("a"), F.col("label").alias("label_a"), "n")
    other = members.where(F.col("says") != F.col("side")).select("gid", F.col("node").alias("b"), F.col("label").alias("label_b"))
    met = other.join(one, "gid").where(F.col("label_a") != F.col("label_b")).groupBy("a", "b").agg(F.max("n").alias("n"))
    no = F.lit(False)
    return met.select(F.col("a").alias("cluster"), "a", _salt(), "b", no.alias("hub"), no.alias("ask"), no.alias("same"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, label) of every row; label is the class's least node, null for null texts."""
    rows = nodes(docs)
    real = rows.where("text IS NOT NULL")
    idf = idf_table(real)
    drawn = written(sketches(real, idf), "sketches")
    banded = drawn.select("node", F.posexplode("buckets").alias("band", "bucket")).select(F.xxhash64("band", "bucket").alias("gid"), "node")
    often = banded.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").select("gid")
    groups, n_groups = compact(banded.join(often, "gid").withColumn("near", F.lit(0.0)), BANDS * drawn.count())
    texts = bucketed(real.join(groups.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "node", "texts")
    found = drawn.select("node", F.col("node").alias("label")).limit(0)
    level, direct, n_direct, n_found = 0, None, 0, 0
    while n_direct or n_groups:
        named = groups.join(found, "node", "left").select("gid", "node", F.coalesce("label", "node").alias("label"), "near")
        sizes = named.groupBy("gid").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"), F.bit_xor(F.xxhash64("node")).alias("who"))
        sizes = sizes.where("n > 1 AND x <> y")
        once = sizes.where(F.col("n") <= SMALL).groupBy("n", "who").agg(F.min("gid").alias("gid")).select("gid")
        links = written(within(compact(named.join(once, "gid"), n_groups)[0], texts, idf), "links")
        large, n_large = compact(named.join(sizes.where(F.col("n") > SMALL).select("gid"), "gid"), n_groups)
        team, pairs, n_pairs = clusters(large, n_large, level, texts, idf) if n_large else (None, None, 0)
        checked = None
        if n_direct:
            pairs = pairs.unionByName(direct) if pairs else direct
        if pairs:
            pairs, _ = compact(pairs, n_pairs + n_direct)
            checked = written(compared(pairs, team, texts, idf), "compared")
            links = links.unionByName(checked.where("linked").select("a", "b"))
        n_links = links.count() + n_found
        found, n_found = compact(components(links.unionByName(found.select(F.col("node").alias("a"), F.col("label").alias("b"))), n_links), 2 * n_links)
        if not team:
            break
        each = checked.where(F.size("keys") > 0).select(F.col("b").alias("node"), "near", F.explode(F.arrays_zip("keys", "says")).alias("k"))
        n_keys = checked.agg(F.sum(F.size("keys"))).first()[0] or 0
        keyed, n_keyed = compact(each.join(found, "node", "left").select(F.xxhash64("k.keys", F.lit(level)).alias("gid"), "node", F.coalesce("label", "node").alias("label"), "near", F.col("k.says").alias("says")), n_keys)
        holds, seeks = (F.count_if(F.col("says") == side).alias(name) for side, name in ((HOLDS, "holds"), (SEEKS, "seeks")))
        kinds = keyed.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("says").alias("least"), holds, seeks)
        kinds, _ = compact(kinds.where(f"x <> y AND (least = {SHINGLE_KEY} OR (holds > 0 AND seeks > 0))"), n_keyed)
        weighed = kinds.where(F.col("least") != SHINGLE_KEY)
        n_met = weighed.where(F.least("holds", "seeks") <= FEW).agg(F.sum(F.col("holds") * F.col("seeks"))).first()[0] or 0
        direct, n_direct = compact(sided(keyed, weighed), n_met)
        open_ = kinds.where((F.col("least") == SHINGLE_KEY) | (F.least("holds", "seeks") > FEW)).select("gid")
        groups, n_groups = compact(keyed.join(open_, "gid", "left_semi").select("gid", "node", "near").distinct(), n_keyed)
        level += 1

    labelled = rows.select("doc_id", "node").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    joined = labelled.join(least, "label", "left")
    return joined.select("doc_id", "node", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row."""
    return classes(docs).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that near-duplicate another: of each class the least (doc_id, digest) stays, once."""
    first = classes(docs).where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("r")).select("r.*")
    names = docs.columns
    keyed = docs.withColumn("__node", F.unhex(F.md5(F.col("text").cast("string"))))
    chosen = first.select(F.col("doc_id").alias("__id"), F.col("node").alias("__kept"))
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__kept"))
    kept = keyed.join(chosen, same, "left_semi")
    once = kept.groupBy("doc_id", "__node").agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in names if c != "doc_id"])
    return once.select(names).unionByName(docs.where("text IS NULL"))
