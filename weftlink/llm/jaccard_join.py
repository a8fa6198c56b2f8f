"""N-gram Jaccard join by a MinHash LSH forest.

A text's shingles are its runs of five words (a shorter text is one shingle). Texts that are equal
form a class; one of them stands for it. Each tree of the forest is a trie of ``DEPTH`` minhashes of
the signature. The matched prefix is shortened from ``DEPTH`` until a pair at the threshold shares it
in some tree with the target recall; texts below one trie node of that depth are candidates of each
other, all of them: a node is compared in blocks, so one with very many texts is many tasks.

Candidates go through three steps, none of which has a cap:

1. Below a node all pairs are held against each other by a 64-byte sketch in memory. Each text passes on
   one likely partner before it, which is compared exactly. Links found that way make families.
2. Nodes are gone through again, now by the texts with a likely partner alone. Texts that likely pairs of
   two families connect are compared exactly, all of them, in blocks; links join families to groups. A pair
   in one family needs no test of its own here, as both texts are in one group by links that were proved.
3. Within a group all texts are compared exactly, through their shingles, in blocks, for the number of
   links. Pairs never leave a task.

So a link is lost only if its texts share no counted prefix, or their sketches differ by far more than
texts at the threshold do: ``expected_recall`` gives both together. Texts that share much but not enough
(a template) may be likely partners, but form no group.

Links are counted in documents: a text's links are the other copies of it and all copies of every
other text with Jaccard similarity at the threshold or above.

Defined cases: null texts and texts without words have no shingles, link with nothing and are each
a class of their own; repeated rows are documents of one class; rows that share an id but not the text
are different documents; a null id stands below all others; very long texts are read whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import connected_components, forget, numbered, staged, text_key

#: Words in a shingle, similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Trees of the forest, minhashes in a full key, recall that shortens prefixes.
TREES, DEPTH, RECALL = 25, 5, 0.99999
#: Minhashes in the sketch (four bits each), and how far below the threshold an estimate may lie.
SKETCH, SLACK = 128, 0.19
#: Texts in a block below a node; texts and shingles in a block of a group.
NODE_BLOCK, BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 512, 400_000
#: Below nodes of at most this many texts pairs are taken over many nodes at once.
FEW = 32

#: Stands for a null id, below all others.
NO_ID = -(1 << 63)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_remembered: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; a worker remembers the words it has seen, up to a bound."""
    import xxhash

    try:
        return np.array(list(map(_remembered.__getitem__, words)), np.uint64)
    except KeyError:
        if len(_remembered) > 500_000:
            _remembered.clear()
        for w in set(words):
            if w not in _remembered:
                _remembered[w] = xxhash.xxh3_64_intdigest(w)
        return np.array(list(map(_remembered.__getitem__, words)), np.uint64)


_BREAKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; empty if it has no words."""
    words = [w for w in text.translate(_BREAKS).split(" ") if w] if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = mixed(out + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def prefix_length(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with the target recall."""
    k = depth
    while k > 1 and 1 - (1 - similarity**k) ** trees < recall:
        k -= 1
    return k


class Minhash:
    """Minhashes by multiply-and-add on 32 bits."""

    def __init__(self, n: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def of(self, shingle_hashes: np.ndarray) -> np.ndarray:
        x = (shingle_hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            y = self.a[:, None] * part  # wraps
            y += self.b[:, None]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            np.minimum(low, y.min(1), out=low)
        return low


def sketched(signature: np.ndarray) -> bytes:
    """Four bits of each of the first minhashes."""
    nibble = (signature[:SKETCH] & 15).astype(np.uint8)
    return (nibble[::2] | nibble[1::2] << 4).tobytes()


def signatures(df: DataFrame, key: str, text: str, n: int = SHINGLE) -> DataFrame:
    """(id, tkey, n_sh, sig, sketch) of every row: the text's key, its number of shingles, its minhashes."""
    hashes = max(SKETCH, TREES * DEPTH)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = Minhash(hashes)
        for batch in batches:
            sizes, sigs, sketches = [], [], []
            for body in batch["text"].array:
                s = shingles(body or "", n)
                signature = family.of(s) if len(s) else None
                sizes.append(len(s))
                sigs.append(signature[: TREES * DEPTH].tobytes() if len(s) else None)
                sketches.append(sketched(signature) if len(s) else None)
            yield pd.DataFrame({"id": batch["id"].array, "tkey": batch["tkey"].array, "n_sh": sizes, "sig": sigs, "sketch": sketches})

    rows = df.select(F.col(key).cast("long").alias("id"), text_key(F.col(text)).alias("tkey"), F.col(text).alias("text"))
    return rows.mapInPandas(sign, "id long, tkey binary, n_sh int, sig binary, sketch binary")


def below_nodes(classes: DataFrame, similarity: float) -> DataFrame:
    """(k, c, blocks): the texts ``c`` below every trie node ``k`` of the counted depth that has several."""
    width = 4 * prefix_length(similarity, TREES, DEPTH, RECALL)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    prefix = F.substr("sig", F.col("tree") * (4 * DEPTH) + 1, F.lit(width))
    spread = classes.select("c", "sig", tree).select("c", F.xxhash64("tree", prefix).alias("k"))
    several = spread.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread.join(several, "k").select("k", "c", F.ceil(F.col("n") / NODE_BLOCK).cast("int").alias("blocks"))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the sketches' minhashes differ, of rows of 64-bit words."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    x &= np.uint64(0x1111111111111111)
    return np.bitwise_count(x).sum(-1, dtype=np.int16)


def pairs_below(node: np.ndarray, block: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing minhashes): all pairs j < i of rows of one node that differ in at most ``most`` minhashes;
    rows of a node stand together. Of a pair of blocks only pairs across count."""
    n = len(node)
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.append(first, n))
    at = np.arange(n) - np.repeat(first, size)
    few = np.repeat(size <= FEW, size)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        ok = d <= most
        found.append((i[ok], j[ok], d[ok]))

    for back in range(1, FEW):
        i = np.flatnonzero(few & (at >= back))
        if not len(i):
            break
        for part in np.array_split(i, -(-len(i) // 65536)):
            keep(part, part - back, apart(words[part], words[part - back]))
    for lo, m in zip(first[size > FEW], size[size > FEW], strict=True):
        own, blk = words[lo : lo + m], block[lo : lo + m]
        mixed_blocks = bool((blk != blk[0]).any())
        for r in range(1, m, 128):
            d = apart(own[r : r + 128, None, :], own[None, : r + 128, :])
            ok = (d <= most) & (np.arange(d.shape[1]) < np.arange(r, r + len(d))[:, None])
            if mixed_blocks:
                ok &= blk[r : r + 128, None] != blk[: d.shape[1]]
            i, j = np.nonzero(ok)
            found.append((i + lo + r, j + lo, d[i, j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def star(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), j the smallest number that i is connected with, that connect what the given pairs do."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[i], top[j])
        new = top.copy()
        for end in (i, j, top[i], top[j]):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == top).all():
            at = np.flatnonzero(top != np.arange(n))
            return at, top[at]
        top = new


def likely_pairs(below: DataFrame, similarity: float, across: bool) -> DataFrame:
    """(a, b), a before b: one likely partner before each text of a node, or, ``across``, pairs that connect just
    the texts that all likely pairs of different families do. ``below`` has (k, c, blocks, sketch, family)."""
    most = int(SKETCH * (1 - (1 / 16 + 15 / 16 * (similarity - SLACK))))
    sure = int(SKETCH * 15 / 16 * (1 - similarity))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        c, block = rows["c"].to_numpy(), rows["block"].to_numpy()
        words = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
        i, j, d = pairs_below(rows["node"].to_numpy(), block, words, most)
        if across:
            family = rows["family"].to_numpy()
            ok = family[i] != family[j]
            i, j = star(len(c), i[ok], j[ok])
        else:
            # The first that is very likely, else the likeliest.
            strong = d <= sure
            order = np.lexsort((j, np.where(strong, 0, d), ~strong, i))
            i, j = i[order], j[order]
            own = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
            i, j = i[own], j[own]
        return pd.DataFrame({"a": c[j], "b": c[i]}).drop_duplicates()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            mark = rows[["k", "x", "y"]].to_numpy()
            new = np.concatenate([[True], (mark[1:] != mark[:-1]).any(1)])
            rows = rows.assign(node=np.cumsum(new))
            cut = int(np.flatnonzero(new)[-1])
            rest = rows.iloc[cut:]
            if cut:
                yield compare(rows.iloc[:cut])
        if rest is not None and len(rest) > 1:
            yield compare(rest)

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = below.withColumn("block", F.pmod(F.xxhash64("c", "k"), F.col("blocks")).cast("int")).select("k", "c", "sketch", "family", "block", other)
    dealt = dealt.select("k", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "c", "block", "sketch", "family")
    order = ["k", "x", "y", "c"]
    return dealt.repartition("k", "x", "y").sortWithinPartitions(*order).mapInPandas(scan, "a long, b long").distinct()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values that two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def linked(both: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """both / (sizes - both) >= similarity, in whole numbers of a millionth; ``sizes`` are sums of both sizes."""
    return both * 1_000_000 >= round(similarity * 1_000_000) * (sizes - both)


def proved(pairs: DataFrame, texts: DataFrame, similarity: float, n: int) -> DataFrame:
    """The pairs (a, b) that are links, by their whole texts (c, text)."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (a, t, u) in enumerate(zip(batch["a"], batch["t"].array, batch["u"].array, strict=True)):
                if a != last:
                    last, left = a, shingles(t, n)
                right = shingles(u, n)
                keep[i] = linked(common(left, right), len(left) + len(right), similarity)
            yield batch.loc[keep, ["a", "b"]]

    held = pairs.join(texts.select(F.col("c").alias("b"), F.col("text").alias("u")), "b").join(texts.select(F.col("c").alias("a"), F.col("text").alias("t")), "a")
    return held.select("a", "b", "t", "u").mapInPandas(verify, "a long, b long")


def links_between(part: pd.DataFrame, similarity: float, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, rows that text i links with) of the texts of two blocks of a group across them, or of one within it;
    a pair comes once."""
    a, b = int(part["x"].iat[0]), int(part["y"].iat[0])
    sets = [shingles(t, n) for t in part["text"]]
    sizes, block = np.array(list(map(len, sets))), part["block"].to_numpy()
    left, right = np.nonzero(block == a)[0], np.nonzero(block == b)[0]
    if not len(left) or not len(right):
        return
    values = np.concatenate([sets[i] for i in right])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for i in left:
        lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        n_hits = hi - lo
        if n_hits.any():
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n_hits)[:-1]]), n_hits) + np.arange(n_hits.sum())
            both = np.bincount(owner[at], minlength=len(right))
            hit = right[linked(both, sizes[i] + sizes[right], similarity)]
            yield i, hit[hit > i] if a == b else hit


def block_links(part: pd.DataFrame, similarity: float, n: int) -> pd.DataFrame:
    """(c, n): how many documents each text of two blocks links with."""
    part = part.sort_values("c", kind="stable").reset_index(drop=True)
    copies, counts = part["copies"].to_numpy(), np.zeros(len(part), np.int64)
    for i, hit in links_between(part, similarity, n):
        counts[i] += copies[hit].sum()
        counts[hit] += copies[i]
    some = counts > 0
    return pd.DataFrame({"c": part["c"].to_numpy()[some], "n": counts[some]})


def block_joins(part: pd.DataFrame, similarity: float, n: int) -> pd.DataFrame:
    """(a, b): links that connect just the texts of different families that all links of two blocks do."""
    part = part.sort_values("c", kind="stable").reset_index(drop=True)
    family, found = part["family"].to_numpy(), []
    for i, hit in links_between(part, similarity, n):
        hit = hit[family[hit] != family[i]]
        if len(hit):
            found.append((np.full(len(hit), i), hit))
    c = part["c"].to_numpy()
    at, top = star(len(part), *(np.concatenate(z) for z in zip(*found, strict=True))) if found else (np.zeros(0, int), np.zeros(0, int))
    return pd.DataFrame({"a": c[top], "b": c[at]})


def in_blocks(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The members (c, n_sh, component, ...) of groups with their texts, dealt into all pairs (x, y) of blocks of
    their group."""
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_sh") / BLOCK_SHINGLES)).cast("int")
    sized = members.groupBy("component").agg(n_blocks.alias("blocks"))
    placed = members.join(sized, "component").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = texts.join(placed.drop("n_sh"), "c").select("*", other).drop("blocks")
    return dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other").groupBy("component", "x", "y")


def groups_of(df: DataFrame, classes: DataFrame, key: str, text: str, similarity: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(c, text) of the texts with a likely partner, and (c, component) of those with a link."""
    below = staged(below_nodes(classes, similarity), "below", like=classes)
    sketches = classes.select("c", "sketch")
    first = staged(likely_pairs(below.join(sketches.withColumn("family", F.col("c")), "c"), similarity, False), "likely", like=classes)
    nodes = staged(first.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "nodes", like=first)
    held = classes.join(nodes, "c").select("c", F.col("id").alias("own"), "tkey")
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("own"), text_key(F.col(text)).alias("tkey"), F.col(text).alias("text"))
    texts = staged(rows.join(held, ["own", "tkey"]).select("c", "text").dropDuplicates(["c"]), "texts", like=df)
    family = staged(connected_components(proved(first, texts, similarity, n)), "families", like=nodes)
    again = below.join(sketches.join(nodes, "c"), "c").join(family.withColumnRenamed("node", "c"), "c", "left").withColumn("family", F.coalesce("component", "c")).drop("component")
    unsure = staged(connected_components(likely_pairs(again, similarity, True)).withColumnRenamed("node", "c"), "unsure", like=nodes)
    unsure = unsure.join(classes.select("c", "n_sh"), "c").join(family.select(F.col("node").alias("c"), F.col("component").alias("family")), "c", "left").withColumn("family", F.coalesce("family", "c"))
    joins = staged(in_blocks(texts, unsure).applyInPandas(lambda part: block_joins(part, similarity, n), "a long, b long"), "joins")
    forget(below, first)
    # Families that a link joins, by the families' names.
    name = lambda end: family.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = joins.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = staged(connected_components(ends), "joined", like=nodes).select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = family.unionByName(joins.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(family.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
    return texts, staged(known.join(joined, "component", "left").select(F.col("node").alias("c"), F.coalesce("top", "component").alias("component")), "groups", like=nodes)


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """One row for each row of ``df``: (id, class_id, n_links, group_id, kept).

    ``class_id``: smallest id with this text; ``n_links``: other documents linked; ``group_id``:
    smallest id reachable by links and equality; ``kept``: whether the row's id is that, and no other
    text of that id in the group comes before.
    """
    return joined_rows(df, key, text, similarity, n).drop("tkey")


def joined_rows(df: DataFrame, key: str, text: str, similarity: float, n: int) -> DataFrame:
    """The rows of ``jaccard_join`` with the key ``tkey`` of each row's text."""
    signed = staged(signatures(df, key, text, n), "signed")
    # Texts without words are no class: each such row stands for itself.
    own = signed.where("n_sh > 0").groupBy("tkey").agg(F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "n_sh", "sig", "sketch")).alias("m"), F.count(F.lit(1)).alias("copies"))
    # Classes are numbered in the order of their ids, so the smallest number of a group has its smallest id.
    classes = staged(numbered(own.select("tkey", "m.*", "copies"), ["id", "tkey"], "c"), "classes", like=signed)
    texts, groups = groups_of(df, classes, key, text, similarity, n)
    # The members of groups, each once, dealt into blocks.
    members = classes.join(groups, "c").select("c", "n_sh", "copies", "component")
    found = in_blocks(texts, members).applyInPandas(lambda part: block_links(part, similarity, n), "c long, n long")
    counts = staged(found.groupBy("c").agg(F.sum("n").alias("n_links")), "links", like=classes)
    heads = groups.select("component").distinct().join(classes.select(F.col("c").alias("component"), F.col("id").alias("group")), "component")
    grouped = groups.join(heads, "component").select("c", "group", (F.col("c") == F.col("component")).alias("head"))
    whole = classes.select("tkey", "c", "id", "copies").join(counts, "c", "left").join(grouped, "c", "left")
    by_class = whole.select(
        "tkey",
        F.col("id").alias("class_id"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("group", "id").alias("group_id"),
        F.coalesce("head", F.lit(True)).alias("head"),
    )
    rows = signed.where("n_sh > 0").select("id", "tkey").join(by_class, "tkey")
    back = lambda c: F.when(F.col(c) == NO_ID, None).otherwise(F.col(c))
    out = rows.select("id", "tkey", back("class_id").alias("class_id"), F.col("n_links").cast("long"), back("group_id").alias("group_id"), (F.col("head") & F.col("id").eqNullSafe(back("class_id"))).alias("kept"))
    alone = signed.where("n_sh = 0").select("id", "tkey", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("group_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stand for their group; of rows that repeat such an id and text, one."""
    found = joined_rows(df.select(key, text), key, text, similarity, SHINGLE)
    kept = found.where("kept").select(F.col("id").alias("id__"), F.col("tkey").alias("tkey__")).distinct()
    rows = df.withColumn("own__", text_key(df[text]))
    rows = rows.join(kept, rows[key].cast("long").eqNullSafe(F.col("id__")) & (F.col("own__") == F.col("tkey__")), "left_semi")
    return rows.dropDuplicates([key, "own__"]).select(df.columns)


def expected_recall(similarity: float = SIMILARITY) -> float:
    """Chance that a pair at the threshold shares the counted prefix in some tree and passes the sketch."""
    k = prefix_length(similarity, TREES, DEPTH, RECALL)
    meet = 1 - math.pow(1 - similarity**k, TREES)
    most, same = int(SKETCH * (1 - (1 / 16 + 15 / 16 * (similarity - SLACK)))), 1 / 16 + 15 / 16 * similarity
    passes = sum(math.comb(SKETCH, d) * (1 - same) ** d * same ** (SKETCH - d) for d in range(most + 1))
    return meet * passes
