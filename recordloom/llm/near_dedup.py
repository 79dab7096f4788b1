"""Near-duplicate documents by a chosen-path set similarity join.

1. Each text becomes its set of word shingles, a fingerprint of the set and a sketch of SKETCH minwise values. Texts
   with one set form a class; only its representative goes on.
2. Chosen paths: in each of TREES independent trees a node's documents branch by their minwise token at a coordinate
   that the node chooses; a node of at most SMALL documents is compared exhaustively on sketches, a larger one
   branches again, into BRANCHES children per document on average (one, and in some nodes a second):
   the inverse of the similarity, so that a pair of it keeps one common path on average. A pair of similarity 0.75 meets at a node of the first level
   with probability 0.75, so twenty trees miss it with 0.25 ** 20. Before it branches, a large node gives up the
   documents that are near its first one (estimate NEAR): that edge stands for them.
3. Nodes emit only a spanning forest of their pairs with estimate CANDIDATE or more, five standard deviations below
   the threshold, so output is linear in a node's size. The forest's components are clusters.
4. Exact check: within a cluster full shingle sets are compared, in pairs of blocks where it is large, and a
   spanning forest of the exact links is emitted. Its components are the result.

Rows of one document are never dropped or capped; a cluster of any size is cut into blocks of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .text import M1, join_small, mix64, spans, written

WIDTH, THRESHOLD = 5, 75
SKETCH, PATHS = 128, 64
TREES, SMALL, BRANCHES, DEPTH = 20, 3000, 4 / 3, 8
NEAR, CANDIDATE = 0.9, 0.5
#: A block of a cluster: at most so many documents, and shingles on average.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 1_000_000
#: Characters of text that are hashed together.
CHUNK = 2_000_000

RANDOM = np.random.default_rng(20_170)
FACTORS = RANDOM.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = RANDOM.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """For each text its sorted distinct shingles, hashed to 64 bits: of `width` words, or of all of them if there are fewer."""
    known = WordHashes()
    split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]  # on bytes: A-Z and ASCII white space only
    flat = np.fromiter((known[w] for ws in split for w in ws), np.uint64, sum(map(len, split)))
    h = flat.copy()
    for j in range(1, width):
        h = mix64(h[: len(h) - 1] * M1 + flat[j:]) if len(flat) > j else h[:0]
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= width:
            out.append(np.unique(h[at : at + n - width + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for w in flat[at : at + n]:
                short = mix64(short * M1 + w)
            out.append(short)
        else:
            out.append(flat[:0])
        at += n
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH minwise values of a non-empty set."""
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        values = (s[i : i + 4096, None] * FACTORS + SHIFTS) >> np.uint64(32)
        np.minimum(least, values.min(axis=0).astype(np.uint32), out=least)
    return least


def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for rows in spans(batch["text"], CHUNK):
            part = batch.iloc[rows]
            sets = shingle_sets([t if isinstance(t, str) else None for t in part["text"]])
            marks = [sketch(s) if len(s) else None for s in sets]
            yield pd.DataFrame({
                "id": part["id"].to_numpy(),
                "n": [len(s) for s in sets],
                "f1": [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                "f2": [int(np.bitwise_xor.reduce(mix64(s ^ M1), initial=np.uint64(0)).view(np.int64)) for s in sets],
                "paths": [None if m is None else m[:PATHS].view(np.int32) for m in marks],
                "marks": [None if m is None else m.astype(np.uint8).tobytes() for m in marks],
            })


def by_key(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], list]) -> Iterator[list]:
    """Runs work on each run of rows with one key; rows come sorted by key, and a run may cross batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        keys = batch["key"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        if held and held[-1]["key"].iat[0] != keys[0]:
            yield work(pd.concat(held) if len(held) > 1 else held[0])
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            held.append(batch.iloc[a:b])
            yield work(pd.concat(held) if len(held) > 1 else held[0])
            held = []
        held.append(batch.iloc[cuts[-2] : cuts[-1]])
    if held:
        yield work(pd.concat(held) if len(held) > 1 else held[0])


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which near(i, js) says which of js are i's neighbours."""
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit].tolist()
            edges += [(i, j) for j in found]
            queue += found
            left = left[~hit]
    return edges


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate edges of each small node, by sketches."""

    def node(rows: pd.DataFrame) -> list:
        ids = rows["rep"].to_numpy()
        if len(ids) < 2:
            return []
        m = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(len(ids), SKETCH)
        least = CANDIDATE * SKETCH
        return [(ids[i], ids[j]) for i, j in forest(len(ids), lambda i, js: (m[js] == m[i]).sum(axis=1) >= least)]

    yield from as_edges(by_key(batches, node))


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact links within each block pair of a cluster, as a spanning forest."""

    def block(rows: pd.DataFrame) -> list:
        ids = rows["rep"].to_numpy()
        if len(ids) < 2:
            return []
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        sizes = np.array([len(s) for s in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            return [(ids[0], ids[1])] if 100 * both >= THRESHOLD * (sizes.sum() - both) else []
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        marked = np.zeros(int(flat.max()) + 1, bool)

        def near(i: int, js: np.ndarray) -> np.ndarray:
            able = (100 * np.minimum(sizes[js], sizes[i]) >= THRESHOLD * np.maximum(sizes[js], sizes[i]))
            out = np.zeros(len(js), bool)
            if able.any():
                own = flat[starts[i] : starts[i] + sizes[i]]
                marked[own] = True
                some = js[able]
                lengths = sizes[some]
                ends = np.cumsum(lengths)
                at = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - lengths), lengths)
                both = np.add.reduceat(marked[flat[at]].astype(np.int64), ends - lengths)
                out[able] = 100 * both >= THRESHOLD * (lengths + sizes[i] - both)
                marked[own] = False
            return out

        return [(ids[i], ids[j]) for i, j in forest(len(ids), near)]

    yield from as_edges(by_key(batches, block))


def as_edges(found: Iterator[list]) -> Iterator[pd.DataFrame]:
    held: list = []
    for edges in found:
        held += edges
        if len(held) > 50_000:
            yield pd.DataFrame(held, columns=["a", "b"], dtype="int64")
            held = []
    if held:
        yield pd.DataFrame(held, columns=["a", "b"], dtype="int64")


def with_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for rows in spans(batch["text"], CHUNK):
            part = batch.iloc[rows]
            sets = shingle_sets([t if isinstance(t, str) else None for t in part["text"]])
            yield pd.DataFrame({"rep": part["id"].to_numpy(), "cluster": part["cluster"].to_numpy(), "blocks": part["blocks"].to_numpy(), "shingles": [s.tobytes() for s in sets]})


def grouped(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work on the rows of each key, keys dealt out by hash; a task holds one key's rows at a time."""
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(work, schema)


def candidates(reps: DataFrame, trees: int, small: int, branches: float, depth: int) -> DataFrame:
    """Edges (a, b) between representatives that may be links; components of them hold every link."""
    token = lambda paths, i: F.element_at(paths, i + 1)
    # equal sketches branch alike for ever: one of each stands for all, joined to it by an edge
    shared = written(reps.groupBy(F.xxhash64("marks", "paths").alias("of_mark")).agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1"))
    same = join_small(reps.select("rep", F.xxhash64("marks", "paths").alias("mark")), shared, F.col("mark") == F.col("of_mark"), "inner").where("rep != head")
    edges = [same.select(F.col("rep").alias("a"), F.col("head").alias("b"))]
    heads = written(reps.join(same.select("rep"), "rep", "left_anti"))
    level = heads.select("rep", F.posexplode(F.slice("paths", 1, trees)).alias("tree", "token")).select(F.xxhash64("tree", "token").alias("key"), "rep")
    for d in range(depth):
        sizes = level.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("first")).where("size > 1")
        nodes = written(level.join(sizes, "key"))
        few = nodes.where(F.col("size") <= small).select("key", "rep").join(heads.select("rep", "marks"), "rep")
        edges.append(grouped(few.select("key", "rep", "marks"), compared, "a long, b long"))
        large = nodes.where(F.col("size") > small)
        if not large.limit(1).count():
            break
        firsts = written(large.select(F.col("first").alias("rep")).distinct().join(heads.select("rep", F.col("paths").alias("first_paths")), "rep").withColumnRenamed("rep", "of_first"))
        large = join_small(large.join(heads, "rep"), firsts, F.col("first") == F.col("of_first"), "inner")
        agree = F.size(F.filter(F.arrays_zip("paths", "first_paths"), lambda z: z["paths"] == z["first_paths"])) / PATHS
        large = written(large.select("key", "rep", "first", "paths", agree.alias("agree")))
        if d == depth - 1:  # the exact check takes what is still large as one cluster
            edges.append(large.where("rep != first").select(F.col("rep").alias("a"), F.col("first").alias("b")))
            break
        edges.append(large.where((F.col("rep") != F.col("first")) & (F.col("agree") >= NEAR)).select(F.col("rep").alias("a"), F.col("first").alias("b")))
        going = large.where((F.col("rep") == F.col("first")) | (F.col("agree") < NEAR))
        twice = going.where(F.pmod(F.xxhash64("key"), F.lit(1000)) < round((branches - 1) * 1000))
        going = going.select("key", "rep", "paths", F.lit(1).alias("child")).union(twice.select("key", "rep", "paths", F.lit(2).alias("child")))
        at = F.pmod(F.xxhash64("key", "child"), F.lit(PATHS)).cast("int")
        level = going.select(F.xxhash64("key", "child", at, token(F.col("paths"), at)).alias("key"), "rep")
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def links(docs: DataFrame, identifier: Column, text: Column, clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Exact links within clusters (rep, cluster), as (a, b): a spanning forest of them."""
    n = clusters.join(sizes, "rep").groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = clusters.join(n.select("cluster", blocks.alias("blocks")), "cluster")
    rows = docs.select(identifier.alias("rep"), text.alias("text")).join(members, "rep").select(F.col("rep").alias("id"), "cluster", "blocks", "text")
    sets = rows.mapInPandas(with_shingles, "rep long, cluster long, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks") > 1, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    tasks = sets.withColumn("pair", F.explode(pairs)).select(F.xxhash64("cluster", "pair.i", "pair.j").alias("key"), "rep", "shingles")
    return grouped(tasks, verified, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, small: int = SMALL, branches: float = BRANCHES, depth: int = DEPTH) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * common shingles >= 75 * shingles of either. component_id is the smallest doc_id
    that can be reached over links, kept whether that is the row's own. A null text or one without words has no
    shingles and links with nothing. Repeated rows and equal texts are linked. Rows that share a doc_id count as
    one document with links of all its texts; a row without doc_id is kept, and its component_id is null. Other
    columns aren't looked at; an empty table gives an empty one.
    """
    identifier, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(identifier.alias("id"), text.alias("text"))
    marks = written(rows.mapInPandas(sketched, "id long, n long, f1 long, f2 long, paths array<int>, marks binary"))
    able = marks.where("n > 0 and id is not null")
    classes = able.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("paths").alias("paths"), F.first("marks").alias("marks"))
    classes = written(classes)
    reps = classes.select("rep", "paths", "marks")
    clusters = written(connected_components(candidates(reps, trees, small, branches, depth)).select(F.col("id").alias("rep"), F.col("component").alias("cluster")))
    exact = written(links(docs, identifier, text, clusters, classes.select("rep", "n")))
    found = written(connected_components(exact).select(F.col("id").alias("rep"), "component"))
    of = classes.select("f1", "f2", F.col("n").alias("m"), "rep").join(found, "rep", "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "m", F.coalesce("component", "rep").alias("component"))
    out = marks.select("id", "n", "f1", "f2").join(of, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **options: object) -> DataFrame:
    """One row of docs for each component that near_duplicates finds, with the columns of docs."""
    key = F.col(f"`{options.get('id_col', 'doc_id')}`").cast("long")
    found = written(near_duplicates(docs, **options).select("doc_id", "kept"))
    left = docs.join(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), key == F.col("__gone"), "left_anti")
    twice = written(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__twice")).agg(F.count("*").alias("n")).where("n > 1").select("__twice"))
    if not twice.limit(1).count():
        return left
    rest = left.join(twice, key == F.col("__twice"), "left_anti")
    return rest.union(left.join(twice, key == F.col("__twice"), "left_semi").withColumn("__key", key).dropDuplicates(["__key"]).drop("__key"))
