"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Texts become sets of 64-bit hashes of their runs of five words (a text of fewer words is one run). Texts with equal
   sets form a class, and one row stands for it from here on.
2. The forest: TREES prefix tries over each class's MinHash signature. A trie's label of a class is DEEPEST hashes (a
   byte of each; the chance of equal bytes of unequal hashes is 256**-d for a prefix of d). The sorted table of labels
   keeps the rows that share at least the shortest prefix with another class; it is far smaller than the input.
3. Prefixes are shortened in passes, deepest first. A pass looks at subtries that branch since the pass before (so hold
   new pairs) and have an open class. Their classes are compared by whole signatures, in blocks of at most BLOCK classes:
   a pair counts in the first trie that it shares. From the links so far and the chance that a link of that similarity
   meets at this depth each class's recall is estimated (found / sum of 1 / chance); a class is settled once that
   reaches the target. A class without a link so far has only the chance at the threshold itself to go by, so it stays
   open down to the depth at which that chance reaches the target (`depth_for`), where all classes end.
4. Near pairs' components are the candidate groups. Within one the exact Jaccard similarity of all pairs is found in
   blocks, as products of 0/1 matrices over the shared runs. A block returns for each class its number of links and its
   group, never pairs.

So nothing is capped: a large group is more blocks, spread over tasks, each of bounded memory. A block's rows carry run
hashes, made once for each class of a group.

Edge cases: null texts and texts without words have no set: each row is a class of its own without links. Repeated
rows and copies share a class. Ids are of any type that can be ordered, may repeat or be null. Links of equal
similarity all count. A very long text is one set like any other. Columns with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shared, textnum
from millrace.llm.components import components

RUN = 5
TREES = 24
DEEPEST = 10
#: Hashes that a prefix loses from one pass to the next.
STEP = 2
#: Of the links of a class, and so of all links, the share to be found.
TARGET = 0.999
#: Classes in one block of a subtrie (signatures of TREES * DEEPEST bytes) and of a candidate group (sets).
BLOCK, SET_BLOCK = 1024, 128
#: A pair goes on if its signatures estimate at least the threshold less this (4 standard deviations at 0.8).
SLACK = 0.1
#: Links found are counted by similarity in steps of this, from the threshold up.
BIN = 0.02
#: Parts that rows of one group are dealt to when a size or a label is joined to them.
SALTS = 64
FIELDS = ["class_id", "group_id", "n_links"]


def met(similarity, depth: int, trees: int = TREES):
    """The chance that two classes share a prefix of that length in some trie."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def depth_for(threshold: float, target: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which pairs at the threshold meet with at least the target chance."""
    depth = deepest
    while depth > 1 and met(threshold, depth, trees) < target:
        depth -= 1
    return depth


def run_sets(data: np.ndarray, offsets: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts, one after the other, each sorted; and where each begins (n + 1 numbers)."""
    data = textnum.ASCII_LOWER[data]
    starts, ends, counts = textnum.words(data, offsets, textnum.ALNUM)
    hashes = textnum.word_hashes(data, starts, ends)
    n = len(offsets) - 1
    keys = textnum.windows(hashes, run)
    at = np.flatnonzero(textnum.whole(counts, run)[: len(keys)])
    text, keys = np.searchsorted(counts, at, "right") - 1, keys[at]
    size = np.diff(counts)
    short = np.flatnonzero((size > 0) & (size < run))
    if len(short):
        own = [textnum.windows(hashes[counts[i] : counts[i + 1]], int(size[i]))[0] for i in short]
        keys, text = np.concatenate([keys, np.array(own, np.uint64)]), np.concatenate([text, short])
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[new], text[new]
    return keys, np.searchsorted(text, np.arange(n + 1))


def _class_keys(keys: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits for each set."""
    import xxhash

    raw, at = keys.tobytes(), at * 8
    return [xxhash.xxh3_128_digest(raw[i:j]) if j > i else None for i, j in zip(at[:-1], at[1:])]


def sign(run: int, trees: int, seed: int = 1):
    """For each text its class and its signature: a byte of each of trees * DEEPEST MinHashes, trie after trie."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, trees * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        keys, at = run_sets(data, offsets, run)
        n, width = len(offsets) - 1, trees * DEEPEST
        some = np.flatnonzero(np.diff(at) > 0)
        least = np.zeros((width, n), np.uint64)
        for k, factor in enumerate(factors if len(some) else []):
            least[k, some] = np.minimum.reduceat(keys * factor, at[:-1][some])
        flat = textnum.mix(least).astype(np.uint8).T.tobytes()
        return [pa.array(_class_keys(keys, at), pa.binary()), pa.array([flat[i * width : (i + 1) * width] for i in range(n)], pa.binary())]

    return shared.text_udf(work, "cls binary, signature binary")


def runs_of(run: int):
    """The sorted run hashes of each text."""

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        keys, at = run_sets(data, offsets, run)
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64)))]

    return shared.text_udf(work, "runs array<long>")


def grouped(parts: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """Runs of rows with equal first columns, from sorted batches; the other columns of each run."""
    rest: pa.Table | None = None

    def runs(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, len(t) - 1), bool)
        for k in range(n_keys):
            col = t.column(k).to_numpy(zero_copy_only=False)
            change |= col[1:] != col[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [len(t)]])

    def given(t: pa.Table, edges: np.ndarray) -> Iterator[tuple[tuple, list[pa.Array]]]:
        cols = [c.combine_chunks() for c in t.columns]
        for i, j in zip(edges[:-1], edges[1:]):
            yield tuple(c[i].as_py() for c in cols[:n_keys]), [c.slice(i, j - i) for c in cols[n_keys:]]

    for part in parts:
        if not part.num_rows:
            continue
        t = pa.Table.from_batches([part])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        edges = runs(t)
        yield from given(t, edges[:-1])
        rest = t.slice(int(edges[-2]))
    if rest is not None:
        yield from given(rest, np.array([0, len(rest)]))


def block_pairs(members: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """members dealt to pairs of blocks (i <= j) of their group, as many as its size asks for; side: 0 in block i, 1 in block j."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    dealt = members.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64("cls"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_n", "_own", "_other", size)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least row of each row's component, from a symmetric matrix of links."""
    n = len(linked)
    root = np.arange(n)
    while True:
        low = root.copy()
        for i in range(0, n, 256):
            part = np.where(linked[i : i + 256], root[None, :], n)
            low[i : i + 256] = np.minimum(low[i : i + 256], part.min(axis=1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _symmetric(n: int, first: np.ndarray, second: np.ndarray, across: np.ndarray) -> np.ndarray:
    linked = np.zeros((n, n), bool)
    linked[np.ix_(first, second)] = across
    return linked | linked.T


def trie_links(depth: int, before: int | None, least: float, threshold: float, trees: int) -> Callable:
    """From blocks (bucket, i, j, tree, side, cls, signature) of subtries at a depth: rows (a, b, bin, n).

    With b: a link between groups of rows that are near. Without: n links of class a, of a similarity in that bin.
    Pairs that share a prefix of length `before` (the pass before) or this prefix in an earlier trie aren't looked at.
    """
    names = ["a", "b", "bin", "n"]
    n_bins = int(round((1 - threshold) / BIN)) + 1

    def prefixes(signs: np.ndarray, d: int) -> np.ndarray:
        h = np.zeros((len(signs), trees), np.uint64)
        for k in range(d):
            h = textnum.mix(h * np.uint64(257) + signs[:, :, k])
        return h

    def compared(signs: np.ndarray, tree: int, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of rows that are new here, and their estimated similarity."""
        own, width = prefixes(signs, depth), trees * DEEPEST
        old = prefixes(signs, before) if before else None
        flat = signs.reshape(len(signs), width)
        step = max(1, 40_000 // max(1, len(second)))
        for k in range(0, len(first), step):
            f = first[k : k + step]
            new = np.ones((len(f), len(second)), bool)
            for t in range(tree):
                new &= own[f, None, t] != own[None, second, t]
            if old is not None:
                for t in range(tree, trees):
                    new &= old[f, None, t] != old[None, second, t]
            x, y = np.nonzero(new)
            x, y = f[x], second[y]
            same = (flat[x] == flat[y]).sum(axis=1) / width
            yield x, y, (same - 1 / 256) / (1 - 1 / 256)

    def lone_pair(x: bytes, y: bytes, tree: int) -> float | None:
        """The similarity of the only two rows of a subtrie, as `compared` tells it."""
        for t in range(tree):
            if x[t * DEEPEST : t * DEEPEST + depth] == y[t * DEEPEST : t * DEEPEST + depth]:
                return None
        if before:
            for t in range(tree, trees):
                if x[t * DEEPEST : t * DEEPEST + before] == y[t * DEEPEST : t * DEEPEST + before]:
                    return None
        same = float((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean())
        return (same - 1 / 256) / (1 - 1 / 256)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = [*zip(*out)] or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names)

        for (_, i, j), (tree, side, cls, signature) in grouped(parts, 3):
            n = len(cls)
            if n < 2:
                continue
            side_ = side.to_numpy()
            first, second = (np.arange(n), np.arange(n)) if i == j else (np.flatnonzero(side_ == 0), np.flatnonzero(side_ == 1))
            if not len(first) or not len(second):
                continue
            if n == 2:
                s = lone_pair(*signature.to_pylist(), tree[0].as_py())
                if s is not None and s >= least:
                    x, y = cls.to_pylist()
                    out.append((x, y, None, None))
                    if s >= threshold:
                        out += [(k, None, min(int((s - threshold) / BIN), n_bins - 1), 1) for k in (x, y)]
                continue
            signs = np.frombuffer(b"".join(signature.to_pylist()), np.uint8).reshape(n, trees, DEEPEST)
            linked: np.ndarray = np.zeros((n, n), bool)
            counts = np.zeros((n, n_bins), np.int64)
            for x, y, s in compared(signs, tree[0].as_py(), first, second):
                keep = (s >= least) & (x != y)
                x, y, s = x[keep], y[keep], s[keep]
                linked[x, y] = True
                sure = s >= threshold
                b = np.minimum(((s[sure] - threshold) / BIN).astype(np.int64), n_bins - 1)
                np.add.at(counts, (x[sure], b), 1)
                if i != j:  # within one block each pair is seen from both sides
                    np.add.at(counts, (y[sure], b), 1)
            names_ = cls.to_pylist()
            root = _roots(linked | linked.T)
            out += [(names_[r], names_[k], None, None) for k, r in enumerate(root) if r != k]
            out += [(names_[k], None, int(b), int(counts[k, b])) for k, b in zip(*np.nonzero(counts))]
            if len(out) > 50_000:
                yield batch()
                out.clear()
        yield batch()

    return run


def exact_matches(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair of sets has a Jaccard similarity of at least the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    whose = np.repeat(np.arange(len(sets)), sizes)
    values, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_ = held[column] > 1
    whose, column = whose[shared_], column[shared_]
    names = np.unique(column)
    column = np.searchsorted(names, column)
    both = np.zeros((len(first), len(second)), np.float32)
    order = np.argsort(column, kind="stable")
    whose, column = whose[order], column[order]
    for low in range(0, len(names), 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((len(sets), min(4096, len(names) - low)), np.float32)
        m[whose[i:j], column[i:j] - low] = 1
        both += m[first] @ m[second].T
    union = sizes[first][:, None] + sizes[second][None, :] - both
    return both >= threshold * union - 1e-6


def exact_links(threshold: float) -> Callable:
    """From blocks of rows (root, i, j, side, cls, runs): for each class its links in the block and a class of its group there."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes, int]] = []

        def batch() -> pa.RecordBatch:
            cols = [*zip(*out)] or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["cls", "peer", "n"])

        for (_, i, j), (side, cls, runs) in grouped(parts, 3):
            names, side_, n = cls.to_pylist(), side.to_numpy(), len(cls)
            first, second = (np.arange(n), np.arange(n)) if i == j else (np.flatnonzero(side_ == 0), np.flatnonzero(side_ == 1))
            if n < 2 or not len(first) or not len(second):
                continue
            sets = [x.values.to_numpy() for x in runs]
            across = exact_matches(sets, first, second, threshold)
            if i == j:
                np.fill_diagonal(across, False)
            linked = _symmetric(n, first, second, across)
            root, links = _roots(linked), linked.sum(axis=1)
            out += [(names[k], names[root[k]], int(links[k])) for k in np.flatnonzero(links)]
            if len(out) > 50_000:
                yield batch()
                out.clear()
        yield batch()

    return work


def forest(classes: DataFrame, floor: int, trees: int = TREES) -> DataFrame:
    """bucket, tree, label, cls: the tries' labels of classes that share a prefix of length floor; a bucket is a trie's subtrie at that depth."""
    labels = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring(F.col("signature"), t * DEEPEST + 1, F.lit(DEEPEST)).alias("label")))
    each = classes.select("cls", F.explode(labels).alias("x")).select("cls", "x.*").withColumn("bucket", F.xxhash64("tree", F.substring("label", 1, floor)))
    # written before they are joined, as all tables of keys here: so both sides are plain and Spark splits hot keys
    shared_ = shared.written(each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "buckets")
    return shared.written(each.join(shared_, "bucket").sortWithinPartitions("bucket", "label"), "forest")


def settled(found: DataFrame, depth: int, threshold: float, target: float, trees: int) -> DataFrame:
    """The classes (cls) of which the links found so far are estimated to be at least the target share; found: a, bin, n of all passes."""
    chance = met(np.minimum(threshold + BIN * np.arange(int(round((1 - threshold) / BIN)) + 1), 1.0), depth, trees)
    whole = F.element_at(F.array(*[F.lit(float(1 / c)) for c in chance]), F.col("bin") + 1)
    sums = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("found"), F.sum(F.col("n") * whole).alias("whole"))
    return sums.filter(F.col("found") >= target * F.col("whole")).select("cls")


def near_pairs(classes: DataFrame, threshold: float, target: float, trees: int = TREES) -> DataFrame:
    """a, b: links that connect the classes whose signatures are near, by shortening prefixes until the target recall."""
    floor = depth_for(threshold, target, trees)
    tries = forest(classes, floor, trees)
    signs, done, links, before = classes.select("cls", "signature"), None, [], None
    depths = [*range(DEEPEST, floor, -STEP), floor]
    for depth in depths:
        at = tries.withColumn("open", F.lit(True))
        if done is not None:
            at = tries.join(done.withColumn("_s", F.lit(True)), "cls", "left").withColumn("open", F.col("_s").isNull()).drop("_s")
        at = at.withColumn("key", F.xxhash64("bucket", F.substring("label", 1, depth)))
        child = F.xxhash64(F.substring("label", 1, before or DEEPEST))
        subtries = at.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("open").alias("_open"), F.min(child).alias("_x"), F.max(child).alias("_y"))
        subtries = subtries.filter("size > 1 AND _open" + (" AND _x <> _y" if before else "")).select("key", "size")
        subtries = shared.written(subtries, "subtries")
        members = at.select("key", "tree", "cls").join(subtries, "key").join(signs, "cls").select("key", "tree", "cls", "signature", "size")
        dealt = block_pairs(members, "key", "size", BLOCK).select("key", "i", "j", "tree", "side", "cls", "signature")
        sorted_ = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        made = sorted_.mapInArrow(trie_links(depth, before, threshold - SLACK, threshold, trees), "a binary, b binary, bin int, n long")
        links.append(shared.written(made, f"pass{depth}"))
        before = depth
        if depth != depths[-1]:
            found = links[0]
            for more in links[1:]:
                found = found.union(more)
            done = settled(found.filter("b IS NULL"), depth, threshold, target, trees)
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out.filter("b IS NOT NULL").select("a", "b")


def salted(rows: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
    """rows left-joined with a table of one row a key, hot keys' rows dealt to SALTS parts by another column."""
    name = shared.free_name(rows, "salt")
    left = rows.withColumn(name, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = other.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, name], "left").drop(name)


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """_id, _text and a 64-bit print of the text: what tells rows of one id apart."""
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).withColumn("_print", F.xxhash64("_text"))


def join_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, target: float = TARGET, run: int = RUN, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(rows: _id, _print, cls of every row of docs; groups: cls, root, n_links of every class with a link)."""
    source = keyed(docs, text, doc_id)
    rows = shared.written(source.withColumn("_s", sign(run, trees)(F.col("_text"))).select("_id", "_print", "_s.cls", "_s.signature"), "signatures")
    # every row of a class has the same signature, so any will do
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("_id", "_print")).alias("_one"), F.first("signature").alias("signature"))
    classes = shared.written(classes, "classes")
    groups = components(near_pairs(classes, threshold, target, trees))
    # only groups beyond a block have a number of blocks to be told
    large = groups.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") > SET_BLOCK)
    members = groups.select(F.col("node").alias("cls"), "root").join(classes.select("cls", F.col("_one._id").alias("_id"), F.col("_one._print").alias("_print")), "cls")
    members = shared.written(members, "members")
    # a class is one (id, print); rows that repeat it have the same text, and one of them stays
    same = F.col("m._print").eqNullSafe(F.col("s._print")) & F.col("m._id").eqNullSafe(F.col("s._id"))
    few = source.join(shared.small(members.select("_print").distinct()), "_print", "left_semi")  # a text of words has a print; texts of other prints aren't shuffled
    texts = members.alias("m").join(few.alias("s"), same).select("root", "cls", "_text").dropDuplicates(["cls"])
    sets = texts.select("root", "cls", runs_of(run)(F.col("_text"))["runs"].alias("runs"))
    sized = salted(sets, large, "root", "cls").withColumn("size", F.coalesce("size", F.lit(1)))
    dealt = block_pairs(sized, "root", "size", SET_BLOCK).select("root", "i", "j", "side", "cls", "runs")
    sorted_ = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = shared.written(sorted_.mapInArrow(exact_links(threshold), "cls binary, peer binary, n long"), "links")
    roots = components(links.select(F.col("cls").alias("a"), F.col("peer").alias("b")))
    n_links = links.groupBy("cls").agg(F.sum("n").alias("n_links"))
    return rows.select("_id", "_print", "cls"), n_links.join(roots.withColumnRenamed("node", "cls"), "cls")


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **more) -> DataFrame:
    """A row for each row of docs: the id, class_id (least id with the same set), group_id (least id in its component of links) and n_links (other classes that its class is linked to)."""
    rows, groups = join_classes(docs, text, doc_id, **more)
    least = rows.filter("cls is not null").groupBy("cls").agg(F.min("_id").alias("class_id"), F.count("*").alias("_n")).join(groups, "cls", "left")
    least = shared.written(least.filter("_n > 1 OR root IS NOT NULL"), "least")  # the others are classes and groups of their own
    tops = least.filter("root is not null").groupBy("root").agg(F.min("class_id").alias("group_id"))
    least = least.join(shared.written(tops, "tops"), "root", "left").select("cls", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.join(shared.written(least, "least"), "cls", "left")
    own = [F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("group_id", "_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    return out.select(F.col("_id").alias(doc_id), *own)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **more) -> DataFrame:
    """docs less all but the row of least id in each group; of rows that repeat that id with the same text one stays, rows without words stay as they are."""
    rows, groups = join_classes(docs, text, doc_id, **more)
    named = rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("_id", "_print")).alias("_one"))
    linked = groups.join(named, "cls").groupBy("root").agg(F.min("_one").alias("_one")).select("_one")
    alone = named.join(groups.select("cls"), "cls", "left_anti").select("_one")
    one, two = shared.free_name(docs, "one"), shared.free_name(docs, "two")

    def places(_id: Column, print_: Column) -> list[Column]:
        """128 bits of id and print, never null: the keys of the join and of the repeated rows."""
        return [F.xxhash64(F.lit(1), _id, print_).alias(one), F.xxhash64(F.lit(2), print_, F.lit(3), _id).alias(two)]

    stays = linked.union(alone).select(*places(F.col("_one._id"), F.col("_one._print"))).withColumn("_stays", F.lit(True))
    # all other documents stay as they are: few keys meet the texts, not a key for each text
    keys = rows.filter("cls is not null").select(*places(F.col("_id"), F.col("_print"))).groupBy(one, two).agg(F.count("*").alias("_n")).join(stays, [one, two], "left")
    odd = shared.written(keys.filter("_stays IS NULL OR _n > 1"), "odd")
    tagged = docs.select(*shared.columns(docs), *places(F.col(doc_id), F.xxhash64(F.col(text))))
    kept = tagged.join(shared.small(odd.select(one, two)), [one, two], "left_anti")
    again = tagged.join(shared.small(odd.filter("_stays").select(one, two)), [one, two], "left_semi").dropDuplicates([one, two])
    return kept.select(*shared.columns(docs)).unionByName(again.select(*shared.columns(docs)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
