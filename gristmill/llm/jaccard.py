"""N-gram Jaccard join: components of documents whose word-shingle sets are similar, by signature trees.

1. Documents with equal shingle sets are one class. Each task sends its classes' shingles, as blobs, to the bucket
   of the shingle's hash; a bucket returns to each class those shingles that another class has too, with how
   many have them.
2. A class can only link if three quarters of its shingles (the threshold's share) are shared with any class at
   all; what merely quotes a common passage ends here. The rest order their shared shingles by rarity, and two
   that link have a shingle in common among the first few of each: these prefixes join classes into candidate
   clusters, larger than the components sought but never smaller.
3. A cluster's classes go into one signature tree (see signature_tree), many clusters a task. A cluster above
   CLUSTER classes is dealt over blocks, each with the cluster's pivots; the blocks' own components become super
   nodes (OR of bitmaps, size range). One task a cluster joins the super nodes that a pivot links. These are drawn into
   lots, each lot meets each other in a task of its own, and only pairs of super nodes that are in different components,
   and whose bound allows a link, are compared set by set.

A group of copies is one class, and reaches each bucket once a batch. No bucket, cluster or task gathers the
texts or all sets of a hot group, and no link is lost. No candidate pair is written out but those of a dealt cluster's
super nodes that the bound leaves open.

Defined results: a null text, and one without words, has an empty set and links with nothing; a null id takes
part, but names a component only if all its ids are null, as null; rows repeated with the same id are one
class; an empty table gives no rows; columns besides the two named are not read, whatever they are called; a very long
text's set is held whole by the task that reads it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BYTE_LOWER, batchwise, groupwise, mix, shingle_sets, span_hashes, sums_by, text_slices, word_bounds
from .shared import Workspace, named, numbered, partitions, place
from .signature_tree import SignatureTree, bitmap_bits

WIDTH = 5
#: Similarity of a link, as a fraction.
SHARE = (75, 100)
#: Shingles a bucket holds; classes a tree holds; pivots of a cluster that is dealt over blocks; super nodes of it that one task compares with as many others.
BUCKET, CLUSTER, PIVOTS, NODES = 3_000_000, 2048, 32, 4096
#: Shingles that a task gathers before it sends them.
HELD = 1_000_000
#: A class's key: 96 bits of its shingles' hashes.
KEY = np.dtype([("a", "<u8"), ("b", "<u4")])
LOW48 = np.uint64((1 << 48) - 1)
#: Classes of one blob from which a shingle counts as common, and a token's upper bits then.
COMMON, EVERY = 16, np.uint64(65535 << 48)


def _sets(column, width):
    """For each slice: first row, row after the last, shingles in order of documents, their counts, class keys."""
    for first, last, buf, offs in text_slices(column):
        starts, ends, doc = word_bounds(buf, offs)
        words = span_hashes(buf, starts, ends, BYTE_LOWER)
        h, counts = shingle_sets(words, np.bincount(doc, minlength=last - first), width)
        key = np.empty(last - first, KEY)
        key["a"] = mix(sums_by(h, counts) + counts.astype(np.uint64))
        key["b"] = mix(sums_by(mix(h + np.uint64(77)), counts)) & np.uint64(0xFFFFFFFF)
        yield first, last, h, counts, key


def _heads(width):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary())])

    def run(batches):
        for batch in batches:
            for first, last, _, counts, key in _sets(batch.column(1), width):
                raw = key.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(counts), pa.array([raw[k : k + 12] for k in range(0, len(raw), 12)], pa.binary())], schema=schema)

    return run


def _fold(key: np.ndarray) -> np.ndarray:
    return key["a"] ^ mix(key["b"].astype(np.uint64) + np.uint64(1))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _blobs(to: np.ndarray, of: np.ndarray, key: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows (to; keys and counts of its classes; their values), of entries sorted by `to`, then `of`. A class of more entries than 16 bits count comes in parts."""
    part = np.arange(len(to)) - np.repeat(_starts(to, of), np.diff(np.append(_starts(to, of), len(to)))) if len(to) else of
    edge = _starts(to, of, part >> 15)
    count, at = np.diff(np.append(edge, len(to))).astype(np.uint16), to[edge]
    cut = np.append(_starts(at), len(at))
    spot = np.append(edge, len(to))[cut]
    return [(int(at[i]), key[of[edge[i:j]]].tobytes(), count[i:j].tobytes(), *(v[x:y].tobytes() for v in values)) for i, j, x, y in zip(cut, cut[1:], spot, spot[1:], strict=False)]


def _columns(table: pa.Table, names: tuple[str, ...], kinds: tuple) -> list[np.ndarray]:
    parts = [[np.frombuffer(x, k) for x, k in zip(r, kinds, strict=True)] for r in zip(*(table.column(c).to_pylist() for c in names), strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _sizes(n_groups: int):
    """Classes with their sizes, to their groups: rows like those of _shared, with no entries."""
    schema = pa.schema([("grp", pa.int32()), *((c, pa.binary()) for c in ("classes", "counts", "tokens", "sizes"))])

    def run(batches):
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), KEY)
            size = batch.column(1).to_numpy().astype(np.uint32)
            grp = (key["a"] % np.uint64(n_groups)).astype(np.int64)
            by = np.argsort(grp, kind="stable")
            cut = np.append(_starts(grp[by]), len(by))
            rows = [(int(grp[by[i]]), key[by[i:j]].tobytes(), bytes(2 * (j - i)), b"", size[by[i:j]].tobytes()) for i, j in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t.type) for c, t in enumerate(schema)], schema=schema)

    return run


def _send(width: int, n_buckets: int):
    """Rows (bucket; keys and counts here of classes; the lower 48 bits of their shingles, in two parts)."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("classes", "counts", "low", "high"))])

    def send(held):
        h, counts, key = (np.concatenate(x) for x in zip(*held, strict=True))
        doc = np.repeat(np.arange(len(counts)), counts)
        _, first, of = np.unique(_fold(key), return_index=True, return_inverse=True)
        mine = (first[of] == np.arange(len(of)))[doc]  # one document of each class
        h, doc = h[mine], doc[mine]
        # What many classes have here is shared for certain: it goes straight to their groups, and a mark to the bucket.
        common, at, have = np.unique(h & LOW48, return_inverse=True, return_counts=True)
        far = have[at] >= COMMON
        grp = (key["a"][doc] % np.uint64(n_buckets)).astype(np.int64)
        by = np.flatnonzero(far)[np.lexsort((doc[far], grp[far]))]
        rows = [(*r, b"") for r in _blobs(n_buckets + grp[by], doc[by], key, EVERY | (h[by] & LOW48))]
        key, marked = np.append(key, np.zeros(1, KEY)), np.unique(h[far])
        h, doc = np.append(h[~far], marked), np.append(doc[~far], np.full(len(marked), len(counts)))
        bucket = (((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(bucket * len(key) + doc, kind="stable")
        h, doc, bucket = h[by], doc[by], bucket[by]
        rows += _blobs(bucket, doc, key, h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t.type) for c, t in enumerate(schema)], schema=schema)

    def run(batches):
        for batch in batches:
            held, weight = [], 0
            for _, last, h, counts, key in _sets(batch.column(1), width):
                held.append((h, counts, key))
                weight += len(h)
                if weight >= HELD or last == batch.num_rows:
                    yield send(held)
                    held, weight = [], 0

    return run


def _shared(n_groups: int):
    """One bucket: to each class's group, its shingles that another class has too, as (classes that have it, up to 65535) << 48 | lower bits."""
    schema = pa.schema([("grp", pa.int32()), *((c, pa.binary()) for c in ("classes", "counts", "tokens", "sizes"))])

    def run(table: pa.Table) -> pa.Table:
        grp = table.column("bucket")[0].as_py() - n_groups
        if grp >= 0:  # on their way to their groups
            return pa.Table.from_arrays([pa.array([grp] * len(table), pa.int32()), *(table.column(c) for c in ("classes", "counts", "low", "high"))], schema=schema)
        key, here, low, high = _columns(table, ("classes", "counts", "low", "high"), (KEY, np.uint16, np.uint32, np.uint16))
        h = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        _, first, of = np.unique(_fold(key), return_index=True, return_inverse=True)
        of = np.repeat(of, here)
        mark = (key["a"][first] == 0) & (key["b"][first] == 0)
        common = np.unique(h[mark[of]])
        by = np.flatnonzero(~mark[of])
        by = by[np.lexsort((of[by], h[by]))]
        h, of = h[by], of[by]
        keep = _starts(h, of)
        h, of = h[keep], of[keep]
        have = np.diff(np.append(_starts(h), len(h)))
        have = np.repeat(have, have)
        have[np.isin(h, common)] = 65535
        some = have > 1
        h, of, have = h[some], first[of[some]], have[some]
        tokens = (np.minimum(have, 65535).astype(np.uint64) << np.uint64(48)) | h
        grp = (key["a"][of] % np.uint64(n_groups)).astype(np.int64)
        by = np.lexsort((of, grp))
        rows = [(*r, b"") for r in _blobs(grp[by], of[by], key, tokens[by])]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], t.type) for c, t in enumerate(schema)], schema=schema)

    return run


def _gather(share):
    """One group of classes: those enough of whose shingles are shared, with these by rarity and the prefix within which linked classes must meet."""
    schema = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])
    p, q = share

    def run(table: pa.Table) -> pa.Table:
        key, here, tokens, _ = _columns(table, ("classes", "counts", "tokens", "sizes"), (KEY, np.uint16, np.uint64, np.uint32))
        _, first, of = np.unique(_fold(key), return_index=True, return_inverse=True)
        n = np.zeros(len(first), np.int64)
        at = 0
        for raw, sizes in zip(table.column("classes").to_pylist(), table.column("sizes").to_pylist(), strict=True):
            many = len(raw) // KEY.itemsize
            if sizes:
                n[of[at : at + many]] = np.frombuffer(sizes, np.uint32)
            at += many
        got = np.bincount(of, here, len(first)).astype(np.int64)
        of = np.repeat(of, here)
        some = (q * got >= p * n)[of]
        of, tokens = of[some], tokens[some]
        by = np.lexsort((tokens, of))
        of, tokens = of[by], tokens[by]
        keep = _starts(of, tokens)  # a class may have sent the same twice
        of, tokens = of[keep], tokens[keep]
        some = (q * np.bincount(of, minlength=len(first)) >= p * n)[of]
        of, tokens = of[some], tokens[some]
        edge = np.append(_starts(of), len(of))
        out = []
        for i, j in zip(edge, edge[1:], strict=False):
            c = of[i]
            out.append((key[first[c]].tobytes(), int(n[c]), tokens[i:j].tobytes(), tokens[i : j + 1 + (-p * int(n[c])) // q].view(np.int64)))
        return pa.Table.from_arrays([pa.array([r[c] for r in out], t.type) for c, t in enumerate(schema)], schema=schema)

    return run


# ---------------------------------------------------------------- components of a graph
def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of nodes 0 to n - 1 and edges a, b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b = x[open_], y[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (jump := root[root])).any():
            root = jump


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) of the components of a, b, without the least nodes' own rows."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(at[: len(a)], at[len(a) :], len(nodes))
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaf], nodes[root[leaf]]


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars on written tables."""
    now, k = work.write(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0"), 0
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node that has less than itself beside it is done if that is one node and nothing else stands beside it.
        near = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        low = work.write(near.select("a", F.least("a", "m").alias("m"), ((F.col("m") < F.col("a")) & (F.col("c") > 1)).alias("open")), f"{name}-low-{k}")  # so that both sides of the joins are exchanges, which AQE can split at a hub
        if not low.agg(F.max("open")).first()[0]:
            work.drop(f"{name}-low-{k}")
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        low = low.drop("open")
        down = both.join(low, "a").where("b > a or b = m").select(F.greatest("a", "b").alias("a"), F.col("m").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        k += 1
        now = work.write(small.where("a <> b").distinct(), f"{name}-{k}")
        work.drop(f"{name}-low-{k - 1}")
        work.drop(f"{name}-{k - 1}")


def _merge(table: pa.Table) -> pa.Table:
    """The links between one dealt cluster's classes, as stars."""
    a, b = (np.frombuffer(b"".join(table.column(c).to_pylist()), KEY) for c in ("a", "b"))
    node, root = (x.tobytes() for x in _stars(a, b))
    cluster, rows = table.column("cluster")[0].as_py(), range(0, len(node), KEY.itemsize)
    return pa.Table.from_arrays([pa.array([cluster] * len(rows), pa.int64()), *(pa.array([raw[k : k + KEY.itemsize] for k in rows], pa.binary()) for raw in (node, root))], names=["cluster", "node", "root"])


# ---------------------------------------------------------------- trees
def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _trees(share):
    """Blocks of classes: (cluster, salt, role, cls, root, and of a dealt cluster's roots the super node)."""
    names = ["cluster", "salt", "role", "cls", "root", "map", "least", "most", "over"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("cls", "ascending")])
        cluster = table.column("cluster").to_numpy()
        cls, n, raw, role = (table.column(c).to_pylist() for c in ("cls", "n", "tokens", "role"))
        dealt, salt, largest = table.column("dealt")[0].as_py(), table.column("salt")[0].as_py(), table.column("largest")[0].as_py()
        edge, out = np.append(np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]])), len(cluster)), []
        for i, j in zip(edge, edge[1:], strict=False):
            tree = SignatureTree([_tokens(x) for x in raw[i:j]], np.array(n[i:j]), None, share, bitmap_bits(largest) if dealt else 0)
            labels = tree.join()
            for k in range(i, j):
                root, node = labels[k - i], (None, None, None, None)
                if dealt and root == k - i:
                    mine = np.flatnonzero(labels == root)
                    node = (np.bitwise_or.reduce(tree.maps[mine], 0).tobytes(), int(tree.sizes[mine].min()), int(tree.sizes[mine].max()), int(tree.excess[mine].max()))
                if dealt or root != k - i:
                    out.append((int(cluster[i]), salt, role[k], cls[k], cls[i + root], *node))
        return pa.Table.from_arrays([pa.array([r[c] for r in out], t.type) for c, t in enumerate(schema)], schema=schema)

    return run


def _open_pairs(share):
    """Super nodes of a dealt cluster, of one draw or of two: pairs in different components, of different draws if there are two, that the bound can't rule out."""
    p, q = share
    schema = pa.schema([("cluster", pa.int64()), ("pair", pa.int64()), ("side", pa.int32()), ("salt", pa.int32()), ("root", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        comp = np.asarray(table.column("comp").combine_chunks().dictionary_encode().indices)
        least, most, over, salt, draw = (table.column(c).to_numpy() for c in ("least", "most", "over", "salt", "draw"))
        roots, (cluster, one, two), out = table.column("root").to_pylist(), (table.column(c)[0].as_py() for c in ("cluster", "one", "two")), []
        maps = np.stack([_tokens(x) for x in table.column("map").to_pylist()])
        for k in range(len(roots)):
            other = k + 1 + np.flatnonzero((comp[k + 1 :] != comp[k]) & (q * most[k + 1 :] >= p * least[k]) & (q * most[k] >= p * least[k + 1 :]) & ((draw[k + 1 :] != draw[k]) | (one == two)))
            if len(other):
                common = np.bitwise_count(maps[other] & maps[k]).sum(1, dtype=np.int64) + np.minimum(over[other], over[k])
                for o in other[(p + q) * common >= p * (least[other] + least[k])]:
                    pair = ((one << 16 | two) << 32) + k * len(roots) + int(o)
                    out += [(cluster, pair, 0, int(salt[k]), roots[k]), (cluster, pair, 1, int(salt[o]), roots[o])]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], t.type) for c, t in enumerate(schema)], schema=schema)

    return run


def _compare(share):
    """Two components of different blocks: an edge if any of their classes link."""
    schema = pa.schema([("cluster", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        side, roots = table.column("side").to_numpy(), table.column("root").to_pylist()
        labels = np.where(side == 0, 0, 1)
        first = [int(np.flatnonzero(side == k)[0]) for k in (0, 1)]
        tree = SignatureTree([_tokens(x) for x in table.column("tokens").to_pylist()], table.column("n").to_numpy(), labels, share)
        found = len(set(tree.join().tolist())) == 1
        edges = [(table.column("cluster")[0].as_py(), roots[first[0]], roots[first[1]])] if found else []
        return pa.Table.from_arrays([pa.array([e[k] for e in edges], t.type) for k, t in enumerate(schema)], schema=schema)

    return run


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE, cluster: int = CLUSTER, nodes_a_task: int = NODES) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach), for each document."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "jaccard")
    n, (p, q) = partitions(spark), share
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heads = work.write(rows.mapInArrow(batchwise(_heads(width)), "doc_id long, n_shingles long, cls binary"), "heads")
    total = heads.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    n_buckets = max(8, int(total) // BUCKET)

    sent = rows.mapInArrow(batchwise(_send(width, n_buckets)), "bucket int, classes binary, counts binary, low binary, high binary")
    to_groups = "grp int, classes binary, counts binary, tokens binary, sizes binary"
    shared = sent.groupBy("bucket").applyInArrow(groupwise(_shared(n_buckets)), to_groups)
    sized = heads.where("n_shingles > 0").select("cls", "n_shingles").distinct().mapInArrow(_sizes(n_buckets), to_groups)
    shared = shared.union(sized)
    active = work.write(shared.groupBy("grp").applyInArrow(groupwise(_gather(share)), "cls binary, n long, tokens binary, prefix array<long>"), "active")

    # Candidate clusters: classes that meet in a prefix, each with the token's least class.
    node = F.xxhash64("cls")
    meet = work.write(active.select(node.alias("x"), F.explode("prefix").alias("token")), "meet")
    low = work.write(meet.groupBy("token").agg(F.min("x").alias("m"), F.count("*").alias("c")).where("c > 1").select("token", "m"), "low")
    edges = meet.join(low, "token").select(F.col("x").alias("a"), F.col("m").alias("b"))
    clusters = components(work, edges, "clusters")
    roots = clusters.select(F.col("root").alias("x"), F.col("root").alias("cluster")).distinct()
    placed = work.write(clusters.select(F.col("node").alias("x"), F.col("root").alias("cluster")).union(roots), "placed")
    members = placed.join(active.select(node.alias("x"), "cls", "n", "tokens"), "x").drop("x")
    members = work.write(members, "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.max(F.octet_length("tokens") / 8).cast("int").alias("largest"))
    sizes = work.write(sizes, "sizes")

    packs = max(n, members.count() // cluster)
    dealt = F.col("size") > cluster
    salts = F.greatest(F.ceil(F.col("size") * 2 / cluster), F.lit(1)).cast("int")
    draw = F.shiftrightunsigned(F.xxhash64("cls", F.lit(1)), 1)
    block = members.join(sizes, "cluster").withColumns({"dealt": dealt, "salts": salts, "draw": draw})
    plain = F.pmod(F.xxhash64("cluster"), F.lit(packs))
    hot = F.col("dealt") & (F.col("draw") / F.lit(2.0**63) < F.lit(float(PIVOTS)) / F.col("size"))
    # A pivot's role is 1 in its own block and 2 in the others.
    own = block.withColumns({"block": F.when(F.col("dealt"), F.col("cluster")).otherwise(plain), "salt": F.when(F.col("dealt"), F.pmod("draw", "salts")).otherwise(0).cast("int"), "role": hot.cast("int")})
    pivot = block.where(hot).withColumns({"block": F.col("cluster"), "own": F.pmod("draw", "salts").cast("int"), "salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "role": F.lit(2)}).where("own <> salt").drop("own")
    columns = ["dealt", "block", "salt", "role", "cluster", "cls", "n", "tokens", "largest"]
    grouped = own.select(columns).union(pivot.select(columns)).groupBy("dealt", "block", "salt")
    local = work.write(grouped.applyInArrow(groupwise(_trees(share)), "cluster long, salt int, role int, cls binary, root binary, map binary, least long, most long, over long"), "local")

    comp = local.where("role < 2").select(F.col("cls").alias("node"), "root")
    nodes = local.where("map is not null")
    if nodes.take(1):
        # What pivots link, a cluster's rows in one task: some PIVOTS a block, far fewer than its classes.
        merge = groupwise(_merge), "cluster long, node binary, root binary"
        links = local.where("role > 0").select("cluster", F.col("cls").alias("a"), F.col("root").alias("b"))
        merged = work.write(links.groupBy("cluster").applyInArrow(*merge), "merged")
        top = merged.select("node", F.col("root").alias("top"))
        part = nodes.join(top, nodes.root == top.node, "left").select("cluster", "salt", "root", "map", "least", "most", "over", F.coalesce("top", "root").alias("comp"))
        # Each draw of nodes meets each other draw, and itself, in a task of its own.
        draws = work.write(nodes.groupBy("cluster").agg(F.ceil(F.count("*") / nodes_a_task).cast("int").alias("draws")), "draws")
        part = part.join(draws, "cluster").withColumn("draw", F.pmod(F.xxhash64("root", "salt"), "draws").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)))
        part = part.withColumns({"one": F.least("draw", "other"), "two": F.greatest("draw", "other")}).drop("draws", "other")
        pairs = work.write(part.groupBy("cluster", "one", "two").applyInArrow(groupwise(_open_pairs(share)), "cluster long, pair long, side int, salt int, root binary"), "pairs")
        if pairs.take(1):
            inside = local.where("map is not null or root <> cls").select("cluster", "salt", "cls", "root")
            sets = pairs.join(inside, ["cluster", "salt", "root"]).join(members, ["cluster", "cls"])
            more = sets.select("cluster", "pair", "side", "root", "n", "tokens").groupBy("cluster", "pair").applyInArrow(groupwise(_compare(share)), "cluster long, a binary, b binary")
            merged = work.write(merged.toDF("cluster", "a", "b").union(more).groupBy("cluster").applyInArrow(*merge), "merged-all")
            top = merged.select("node", F.col("root").alias("top"))
        comp = comp.join(top.withColumnRenamed("node", "old"), F.col("root") == F.col("old"), "left").select("node", F.coalesce("top", "root").alias("root"))

    least = work.write(heads.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least")), "classes")
    labelled = least.join(comp, least.cls == comp.node, "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    tops = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = work.write(labelled.join(tops, "root").select("cls", "component_id"), "labels")
    for name in ("meet", "active", "members"):
        work.drop(name)
    full = heads.where("n_shingles > 0").join(classes, "cls").select("doc_id", "n_shingles", "component_id")
    return full.union(heads.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id names their component, with all their columns; of rows with that id, all."""
    own, own_id = numbered(docs), place(docs, id_col)
    kept = similar_components(own, own_id, place(docs, text_col)).where("doc_id <=> component_id").select("doc_id").distinct()
    return named(own.join(kept, F.col(own_id).cast("long").eqNullSafe(F.col("doc_id")), "left_semi"), docs)
