"""Exact self-join of shingle sets by Jaccard similarity with several global token orders.

Two sets of similarity t or more share a token of their prefixes (the first n - ceil(t n) + 1
tokens) under *every* global order of the tokens. Three orders are used: rarest first (document
frequencies over all rows, ties by hash), and two independent hash orders. A pair is a candidate
if it shares a prefix token under all three; candidates are verified on the whole sets.

Document frequencies are exchanged in blocks: rows are dealt into chunks, each chunk sends its
sorted distinct tokens as packed blocks of a token range, and gets a byte for every token back.
Tokens found in one row only cannot be shared, so they leave prefixes after these are cut.

Sets that are equal are one class. Within the classes that share a token, links are verified in
rounds: first with one centre for each token, then with other centres and only across the
components found so far, at last all pairs across components that are left and that the places of
their shared token do not rule out. So copies in thousands need a number of comparisons in
proportion to their number, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import WORD, mix, row_digest, row_key, secret, table, text_bytes
from .shingles import shingle_sets

_SALTS = (np.uint64(0x632BE59BD9B4E019), np.uint64(0x8CB92BA72F3D8DD7))
_ROW = "doc_id long, fp long, n int, node string, rare int, pre array<long>, second array<long>, third array<long>, toks binary"


def _chunk_sets(t: pa.Table, width: int, key: bytes):
    data, offsets = text_bytes(t["text"])
    sets = shingle_sets(data, offsets, key, width)
    return sets, np.concatenate([np.zeros(0, np.uint64), *sets])


#: Bits of a token's hash that its document frequency is counted by; two tokens that agree in them count as one.
_KEPT = 48


def _pack(tokens: np.ndarray) -> bytes:
    """Sorted tokens as byte planes of their differences: the high planes are nearly all zero, and compress away."""
    return np.diff(tokens, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u8").ravel(), dtype=np.uint64)


def _send(width: int, blocks: int, key: bytes):
    """A chunk of documents -> its distinct tokens in blocks of a token range."""

    def run(t: pa.Table) -> pa.Table:
        tokens, here = np.unique(_chunk_sets(t, width, key)[1] >> np.uint64(64 - _KEPT), return_counts=True)
        here = here.astype(np.uint32)
        found, first = np.unique(_block(tokens, blocks), return_index=True)
        cut = [*zip(first, np.append(first[1:], len(tokens)), strict=True)]
        chunk = t["chunk"][0].as_py() if len(t) else 0
        cols = {"chunk": pa.array([chunk] * len(found), pa.int32()), "block": pa.array(found, pa.int32())}
        cols |= {k: pa.array([f(x[a:b]) for a, b in cut], pa.binary()) for k, x, f in (("tokens", tokens, _pack), ("here", here, np.ndarray.tobytes))}
        return pa.table(cols)

    return run


def _block(tokens: np.ndarray, blocks: int) -> np.ndarray:
    return ((tokens >> np.uint64(_KEPT - 32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)


def _grade(counts: np.ndarray) -> np.ndarray:
    """Counts to 127 as they are; larger ones by their logarithm, so that a byte keeps their order."""
    high = 128 + 4 * np.log2(np.maximum(counts, 128) / 128)
    return np.where(counts < 128, counts, np.minimum(high, 255)).astype(np.uint8)


def _count(t: pa.Table) -> pa.Table:
    """A block of all chunks -> for each chunk the graded document frequencies of its tokens."""
    parts = [_unpack(x.as_py()) for x in t["tokens"]]
    here = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t["here"]])
    _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    grades = _grade(np.bincount(inverse, here).astype(np.int64))[inverse]
    ends = np.cumsum([len(p) for p in parts])[:-1]
    return pa.table({"chunk": t["chunk"], "block": t["block"], "grades": pa.array([g.tobytes() for g in np.split(grades, ends)], pa.binary())})


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(width: int, percent: int, key: bytes):
    def run(docs: pa.Table, graded: pa.Table) -> pa.Table:
        sets, every = _chunk_sets(docs, width, key)
        _, inverse = np.unique(every >> np.uint64(64 - _KEPT), return_inverse=True)
        order = np.argsort(graded["block"].to_numpy())
        packed = graded["grades"].to_pylist()
        grades = np.frombuffer(b"".join(packed[i] for i in order), np.uint8)
        grades = grades[inverse] if len(every) else grades
        rows = []
        at = 0
        for s in sets:
            n = len(s)
            g = grades[at : at + n]
            at += n
            node = hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if n else ""
            row = [n, node, None, None, None, None, None]
            if n and (g > 1).any():
                p = prefix_length(n, percent)
                orders = [np.lexsort((mix(s), g)), np.argsort(mix(s ^ _SALTS[0])), np.argsort(mix(s ^ _SALTS[1]))]
                cut = [o[:p] for o in orders]
                shared = [s[o[g[o] > 1]].view(np.int64) for o in cut]
                if all(len(x) for x in shared):
                    row[2:] = [int((g == 1).sum()), *shared, s[g > 1].tobytes()]  # tokens of no other row are in no intersection
            rows.append(row)
        kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
        names = ["n", "node", "rare", "pre", "second", "third", "toks"]
        cols = {k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(zip(names, kinds, strict=True))}
        return pa.table({"doc_id": docs["doc_id"], "fp": docs["fp"], **cols})

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, n, m in zip(batch["x"], batch["y"], batch["n"].to_pylist(), batch["m"].to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = np.count_nonzero(y[at] == x)
                good.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): the smallest node each node of ``edges`` (u, v) is connected to, by repeated hooking and contraction.

    Repeated edges count once; an edge from a node to itself or with a null end links nothing; no edges, no rows.
    """
    edges = table(edges.select("u", "v").where("u <> v").distinct(), f"{name}-edges")
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        up = table(up, f"{name}-parents")
        jump = up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))
        if label is None:
            label = jump.select(F.col("u").alias("node"), F.col("p").alias("comp"))
        else:
            moved = jump.select(F.col("u").alias("comp"), F.col("p").alias("to"))
            label = label.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        label = table(label, f"{name}-labels")
        left = edges.join(jump.withColumnRenamed("p", "a"), "u").join(jump.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
        edges = table(left.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}-edges")
        if edges.isEmpty():
            return label


def _classes(docs: DataFrame, percent: int, width: int, chunk_chars: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, n, node, ...) of every row, and (node, comp, best): best is the least (doc_id, fp) of the component."""
    spark = docs.sparkSession
    ship(spark)
    key = secret()
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(chars / chunk_chars))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row_key())
    dealt = keyed.select(F.pmod(F.xxhash64("did", "fp"), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "fp", "text")
    sent = dealt.groupBy("chunk").applyInArrow(_send(width, chunks, key), "chunk int, block int, tokens binary, here binary")
    graded = sent.groupBy("block").applyInArrow(_count, "chunk int, block int, grades binary")
    rows = table(dealt.groupBy("chunk").cogroup(graded.groupBy("chunk")).applyInArrow(_prefixes(width, percent, key), _ROW), "shingle-rows")
    del dealt, sent, graded
    nodes = rows.where("toks is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "rare", "pre", "second", "third", "toks")))
    nodes = table(nodes, "shingle-nodes")
    posts = nodes.select("node", "n", "rare", F.posexplode("pre").alias("i", "token")).withColumn("i", F.col("i") + F.col("rare"))
    crowd = table(posts.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "crowd")
    posts = table(posts.join(crowd, "token"), "postings")
    links = _links(posts, nodes, percent)

    # ids before none at all
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    low = rows.where("n > 0").groupBy("node").agg(F.min(me).alias("low"))
    low = low.join(links, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "low")
    best = table(low.groupBy("comp").agg(F.min("low").alias("best")), "bests")
    return rows, low.join(best, "comp").select("node", "comp", "best")


def jaccard_classes(docs: DataFrame, percent: int = 80, width: int = 5, chunk_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are not read).

    Sets are distinct ``width``-word shingles of the text, A-Z lower-cased; with fewer words, the whole
    sequence as one; a null, empty or blank text has the empty set, links with nothing and is its own
    component. Rows link when 100 * |A & B| >= percent * |A | B|; component_id is the smallest doc_id
    reachable. Equal sets link, repeated rows included. A null doc_id is the smallest only in a
    component that has no other. Empty tables give empty results.
    """
    rows, classes = _classes(docs, percent, width, chunk_chars)
    found = rows.select("doc_id", "n", "node").join(classes, "node", "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, chunk_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, of which one row of each component of :func:`jaccard_classes` stays: the one with the least doc_id.

    Rows with an empty set (null, empty and blank texts) stay; of rows equal in doc_id and text the one whose whole row has the least
    digest stays, so the choice is the same in all partitionings; an empty table stays empty.
    """
    rows, classes = _classes(docs, percent, width, chunk_chars)
    best = classes.select("best").distinct().select(F.coalesce("best.doc_id", F.lit(-(2**63))).alias("did"), F.col("best.fp").alias("fp"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns, strict=True)), *row_key(), row_digest(docs).alias("row"))
    full = F.coalesce(F.col(names[docs.columns.index("text")]), F.lit("")).rlike(WORD)
    # equal rows are one before they are dealt
    one = keyed.where(full).groupBy("did", "fp").agg(F.min_by(F.struct(*names), "row").alias("r")).join(best, ["did", "fp"]).select("r.*")
    return one.unionByName(keyed.where(~full).select(*names)).toDF(*docs.columns)


def _links(posts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of the nodes that have a link."""
    label = posts.select("node").distinct().select("node", F.col("node").alias("comp"))
    label = table(label, "links")
    tried = None
    for k in range(4):
        lively = posts.join(label, "node")
        mixed = lively.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        lively = table(lively.join(mixed, "token"), f"lively{k}")
        if lively.isEmpty():
            break
        if k < 3:
            # the set with the fewest tokens of its own is likest to the others
            own = F.floor(F.col("rare") * (1000, 50, 0)[k] / F.col("n"))
            order = F.struct(own.alias("own"), F.col("node") if k == 0 else F.xxhash64("node", "token", F.lit(k)))
            centre = lively.groupBy("token").agg(F.min(F.struct(order.alias("o"), F.struct("node", "comp", "n", "i").alias("c"))).alias("m")).select("token", "m.c")
            pairs = lively.join(centre, "token").select(F.col("node").alias("x"), "comp", "n", "i", F.col("c.node").alias("y"), F.col("c.comp").alias("comp2"), F.col("c.n").alias("n2"), F.col("c.i").alias("i2"))
        else:
            other = lively.select("token", F.col("node").alias("y"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("i").alias("i2"))
            pairs = lively.withColumnRenamed("node", "x").join(other, ["token"]).where("x < y")
        # nothing before a pair's first shared token is shared, which bounds its intersection; i, i2: places in the first order
        bound = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))
        fits = (F.col("comp") != F.col("comp2")) & (100 * bound >= percent * (F.col("n") + F.col("n2") - bound))
        pairs = pairs.where(fits).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        side = lambda a, b: nodes.select(F.col("node").alias(a), *(F.col(c).alias(f"{a}_{c}") for c in ("n", "second", "third", "toks")))
        pairs = table(pairs, f"pairs{k}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        both = pairs.join(side("u", 0), "u").join(side("v", 0), "v")
        both = both.where(F.arrays_overlap("u_second", "v_second") & F.arrays_overlap("u_third", "v_third"))
        good = both.select("u", "v", F.col("u_toks").alias("x"), F.col("v_toks").alias("y"), F.col("u_n").alias("n"), F.col("v_n").alias("m")).mapInArrow(_verify(percent), "u string, v string")
        linked = label.select("node", "comp")
        edges = good.join(linked.toDF("u", "a"), "u").join(linked.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        moved = components(edges, f"round{k}").toDF("comp", "to")
        label = table(label.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "links")
    return label
