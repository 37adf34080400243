"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct word shingles.  A signature has the lowest ``BITS`` bits of the least hash under each
of ``positions`` hash functions; two sets of similarity t differ in a binomial number of positions.  The radius is the
smallest number of differing positions that sets of similarity ``least`` exceed with a probability of at most ``MISS``.
Signatures are cut into m chunks so that of two within the radius some chunk differs in at most ``errors`` positions
(pigeonhole).  The allowed errors of a chunk are enumerated as the positions that may differ: each choice of them is
left open, and the rest of the chunk is a key.  So all pairs within the radius share a key; none is missed.

Keys that one set has alone are dropped.  Signatures that share a key are compared and linked within the radius; a
signature is linked once to each class that it touches, so dense groups cost no pairs of links.  A key of more than
``PART`` sets is cut into parts, and every set asks the parts before its own.  The links' classes are candidates only:
their texts come together and a link counts if the whole sets have the similarity.

Equal sets are one from the start, so copies cost nothing, a hot group of copies included.

Defined results: A-Z are lower-cased, words are parted by ASCII white space; a text of fewer words than a shingle is
one shingle; null counts as empty; texts without words have an empty set and are linked with nothing, not with each
other either.  Null ids are larger than any other; a class without any id has a null component.  Repeated rows are rows
of their own with one component; an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.catalog import query, table
from hushframe.llm.components import components
from hushframe.llm.scratch import Scratch
from hushframe.llm.shingle_sets import BLOCK, WORDS, alike_links, shingles
from hushframe.llm.simhash import fingerprint, link_prints, perhaps_in, signed
from hushframe.session import written

LEAST = 0.85
POSITIONS = 65
BITS = 16
MISS = 1e-6
ERRORS = 1  # positions of a chunk that may differ
PART = 20_000  # sets of one part of a key
NOTHING = shingles(None)[0]
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def radius_of(positions: int, least: float, miss: float = MISS) -> int:
    """Differing positions that two sets of similarity ``least`` exceed with probability ``miss`` at most."""
    p, tail, t = 1.0 - least, 0.0, positions
    while t > 0:
        tail += math.comb(positions, t) * p**t * (1.0 - p) ** (positions - t)
        if tail > miss:
            return t
        t -= 1
    return 0


def chunks_of(positions: int, radius: int, errors: int = ERRORS) -> list[list[int]]:
    """Chunks of positions, one more than the radius holds groups of ``errors + 1``."""
    m = min(positions, radius // (errors + 1) + 1)
    edges = [positions * i // m for i in range(m + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def hash_functions(positions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, positions, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, positions, np.uint64)


def signature(s: np.ndarray, functions: tuple[np.ndarray, np.ndarray], block: int = 2048) -> np.ndarray:
    """The low bits of the least hash of a set under every function."""
    times, plus = functions
    least = np.full(len(times), ~np.uint64(0))
    for at in range(0, len(s), block):
        least = np.minimum(least, (s[at:at + block, None] * times + plus).min(axis=0))
    return ((least * GOLDEN) >> np.uint64(64 - BITS)).astype("<u2")


def chunk_keys(signatures: np.ndarray, chunks: list[list[int]], errors: int = ERRORS) -> np.ndarray:
    """Keys of each signature (a row): a hash of each chunk with each choice of ``errors`` positions left open."""
    wide, out = signatures.astype(np.uint64), []
    for c, chunk in enumerate(chunks):
        for left_open in combinations(chunk, min(errors, len(chunk) - 1)):
            key = np.full(len(wide), (c << 32) + sum((p + 1) << (8 * i) for i, p in enumerate(left_open)), np.uint64) * GOLDEN
            for p in chunk:
                if p not in left_open:
                    key = (key ^ wide[:, p]) * GOLDEN
                    key ^= key >> np.uint64(29)
            out.append(key)
    return np.stack(out, axis=1)


def member_links(nodes: np.ndarray, prints: np.ndarray, askers: np.ndarray, asking: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of the classes among the members, and one of each asker to each of them that it touches."""
    links, label, left = [], np.full(len(nodes), -1), np.arange(len(nodes))
    for start in range(len(nodes)):
        if label[start] >= 0:
            continue
        label[start], todo = start, [start]
        left = left[label[left] < 0]
        while todo and len(left):  # those found are compared only with what has no class yet
            at = todo.pop()
            near = left[(prints[left] != prints[at]).sum(axis=1) <= radius]
            label[near] = start
            links += [(int(nodes[x]), int(nodes[at])) for x in near]
            todo += near.tolist()
            left = left[label[left] < 0] if len(near) else left
    for node, own in zip(askers.tolist(), asking):
        near = np.flatnonzero((prints != own).sum(axis=1) <= radius)
        links += [(node, int(nodes[x])) for x in near[np.unique(label[near], return_index=True)[1]]]
    return links


def signed_sets(docs: DataFrame, words: int, positions: int, seed: int, text: str, id: str, prints: bool = False) -> DataFrame:
    """(id, key, set, n, signature) per document: md5 of the text, 128-bit digest and size of its set; null set: empty.

    With ``prints`` also (print), the SimHash fingerprint as a signed long.
    """
    kind = docs.schema[id].dataType.simpleString()
    functions = hash_functions(positions, seed)
    more = ["print"] * prints

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for t in b.column(2):
                s = shingles(t.as_py(), words)
                s = () if len(s) == 1 and s[0] == NOTHING else s
                out[0].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out[1].append(len(s))
                out[2].append(signature(s, functions).tobytes() if len(s) else None)
            given = [pa.array([signed(fingerprint(t.as_py())) for t in b.column(2)], pa.int64()) for _ in more]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), *given],
                                             ["id", "key", "set", "n", "signature", *more])

    return docs.select(F.col(f"`{id}`").alias("id"), text_key(text).alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, f"id {kind}, key binary, set binary, n bigint, signature binary" + ", print bigint" * len(more))


def text_key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def as_rows(column: pa.Array, positions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, positions)


def candidate_links(sets: DataFrame, least: float, positions: int, held: Callable, part: int = PART) -> DataFrame:
    """(node, signature) to (u, v): links whose classes are those of all pairs within the radius."""
    radius = radius_of(positions, least)
    chunks = chunks_of(positions, radius)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = chunk_keys(as_rows(b.column(1), positions), chunks)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), found.shape[1]))], ["key", "node"])

    keyed = sets.select("node", "signature").mapInArrow(keys, "key bigint, node bigint")
    shared = held(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "minhash-keys")
    parts = F.ceil(F.col("n") / part).cast("int")
    met = keyed.join(shared, "key").withColumn("home", F.pmod(F.xxhash64("node"), parts).cast("int"))
    placed = met.select("key", "node", "home", F.explode(F.sequence(F.lit(0), F.col("home"))).alias("part"))
    placed = placed.withColumn("asks", (F.col("part") != F.col("home")).cast("int")).join(sets, "node")
    placed = placed.select("key", "part", "asks", "node", "signature").repartition("key", "part").sortWithinPartitions("key", "part", "asks", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for b in batches:
            whole = b if whole is None or not whole.num_rows else pa.concat_batches([whole, b])
            place = np.stack([whole.column(0).to_numpy(), whole.column(1).to_numpy()])
            ends = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            if len(ends):  # the last group may go on in the next batch
                yield linked(whole.slice(0, int(ends[-1])), np.concatenate(([0], ends)))
                whole = whole.slice(int(ends[-1]))
        if whole is not None and whole.num_rows:
            yield linked(whole, np.array([0, whole.num_rows]))

    def linked(b: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        asks, nodes, prints = b.column(2).to_numpy(), b.column(3).to_numpy(), as_rows(b.column(4), positions)
        pairs, more = edges[:-1][np.diff(edges) == 2], []
        near = (prints[pairs] != prints[pairs + 1]).sum(axis=1) <= radius if len(pairs) else np.empty(0, bool)
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if z - a > 2:
                k = a + int(np.searchsorted(asks[a:z], 1))
                more += member_links(nodes[a:k], prints[a:k], nodes[k:z], prints[k:z], radius)
        u = np.concatenate([nodes[pairs][near], np.array([x[0] for x in more], np.int64)])
        v = np.concatenate([nodes[pairs + 1][near], np.array([x[1] for x in more], np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return placed.mapInArrow(run, "u bigint, v bigint").distinct()


def print_links(sets: DataFrame, radius: int, held: Callable) -> DataFrame:
    """(node, print) to (u, v): links whose classes are those of all fingerprints within the radius, equal ones included."""
    prints = held(sets.groupBy("print").agg(F.min("node").alias("first"), F.count("*").alias("n")), "simhash-groups")
    equal = sets.join(prints.filter("n > 1").select("print", "first"), "print").filter("node <> first")
    u, v = (prints.select(F.col("print").alias(f"of_{x}"), F.col("first").alias(x)) for x in "uv")
    near = link_prints(prints.select("print"), radius).select(F.col("u").alias("of_u"), F.col("v").alias("of_v")).distinct()
    return near.join(u, "of_u").join(v, "of_v").select("u", "v").unionByName(equal.select(F.col("node").alias("u"), F.col("first").alias("v")))


def near_sets(docs: DataFrame, least: float, words: int, positions: int, seed: int, text: str, id: str, block: int, part: int,
              keep: Callable[[DataFrame, str], DataFrame] = written, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, key, set, n) per document, (set, root) of the sets that are linked); ``keep`` stores both, ``root`` names a class.

    With ``radius``, sets whose SimHash fingerprints are within it are candidates as well.
    """
    given = ["print"] * (radius is not None)
    full = keep(signed_sets(docs, words, positions, seed, text, id, radius is not None), "minhash-signatures")
    with Scratch(docs.sparkSession) as held:
        sets = full.filter("set is not null").groupBy("set").agg(F.min(F.struct("key", "signature", *given)).alias("one"))
        sets = held(sets.select(F.monotonically_increasing_id().alias("node"), "set", "one.key", "one.signature", *[f"one.{x}" for x in given]), "minhash-sets")
        links = held(candidate_links(sets.select("node", "signature"), least, positions, held, part), "minhash-links")
        if radius is not None:
            links = links.unionByName(held(print_links(sets.select("node", "print"), radius, held), "simhash-links"))
        clusters = held(components(links, store=held).distinct(), "minhash-clusters")
        wanted = sets.join(clusters, "node").select("key", "node", "root")
        keyed = docs.select(text_key(text).alias("key"), F.col(f"`{text}`").alias("text")).withColumn("row", F.xxhash64("key"))
        near = perhaps_in(keyed, wanted.select(F.xxhash64("key").alias("row"))).filter("perhaps").select("key", "text")
        texts = near.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")  # copies of a text are combined map-side
        texts = held(texts.select("root", "node", "text"), "minhash-texts")
        roots = components(alike_links(texts, words, least, block), store=held).distinct()
        found = keep(sets.join(roots, "node").select("set", "root"), "minhash-classes")
    return full.select("id", "key", "set", "n"), found


def near_classes(docs: DataFrame, least: float = LEAST, words: int = WORDS, positions: int = POSITIONS, seed: int = 42, text: str = "text",
                 id: str = "doc_id", block: int = BLOCK, part: int = PART) -> DataFrame:
    """One row per document: id, n (size of its set), component (smallest id reachable over links, its own included), kept."""
    rows, found = near_sets(docs, least, words, positions, seed, text, id, block, part)
    named = rows.groupBy("set").agg(F.min("id").alias("least")).filter("set is not null").join(found, "set", "left")
    group = F.coalesce(F.col("root").cast("string"), F.hex("set")).alias("group")
    named = named.select("set", "least", group)
    best = named.groupBy("group").agg(F.min("least").alias("component"))
    labels = named.join(best, "group").select("set", "component")
    sized = rows.filter("set is not null").join(labels, "set").select("id", "n", "component")
    whole = sized.unionByName(rows.filter("set is null").select("id", "n", F.col("id").alias("component")))
    return whole.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x20\x09-\x0D]+') as w from documents),
c as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
       else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from d),
n as (select doc_id, len(s)::bigint as n from c),
g as (select doc_id, unnest(s) as s from c),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, got) as (select doc_id, doc_id from n union select r.doc_id, l.v from r join l on l.u = r.got),
m as (select doc_id, min(got) as component_id from r group by 1)
select n.doc_id, n.n as n_shingles, component_id, n.doc_id = component_id as kept from n join m on m.doc_id = n.doc_id
"""


@query("op13_minhash", SQL)
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of five-word shingles have a similarity of 0.85 or more."""
    classes = near_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")
