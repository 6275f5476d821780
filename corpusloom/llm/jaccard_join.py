"""N-gram Jaccard join by prefix trees: groups of documents whose 5-word shingle sets overlap by 3/4.

Texts are lower-cased (A-Z); words are what white space separates; a document's set holds its distinct
5-word shingles, or its whole word sequence as one if shorter. Two documents link when 100 * |A and B| >=
75 * |A or B|; a component is what links reach.

1. Blocks exchange runs of shingle hashes and learn in how many blocks each stands. A document fewer than
   3/4 of whose shingles stand in any other document links with nothing and is done here.
2. Equal sets are one class. All sets are ordered globally: rare shingles first, then by hash. Two sets that link
   share a shingle of their prefixes (the first |A| - ceil(3/4 |A|) + 1). The sets that have a shingle in their prefixes
   form its list, and a list goes to the group of its smallest member: every member of a group shares a shingle with that
   one, nothing is closed transitively, and lists of the same sets fall together. Lists of more than ``HOT`` sets have groups
   of their own: tiles (3.) connect what they hold of copies, and where components stay apart their sets are
   grouped by a second shingle too, as sets that link share two in prefixes that are longer by one.
3. A group is cut into tiles of about 128 classes, its smallest member in each. In a tile, sets go into a trie in the global order and each
   set traverses it, sharing the overlap counted so far between all sets of a subtree and pruning the
   subtree once the remaining lengths cannot reach 3/4. Classes that are already connected need no further
   link, so each tile gives a spanning forest, not all pairs.
4. Groups of several tiles go on: one member of each component of each tile meets the others in new tiles. At
   last, pairs of tiles are traversed only where they hold different components. No link is lost: every pair
   of classes of a group is either compared or already connected.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and are their own component.
A null doc_id takes part; it is never the smallest of a component that has another. Rows that share a doc_id
are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import runs as R
from corpusloom.llm.blocks import Bases, Block, Words, blocks_of, draw_bases, mix, pack
from corpusloom.llm.components import UnionFind, connected_components
from corpusloom.session import durable, prepare, release_shuffles, shuffle_partitions

U = np.uint64
SHINGLE, PERCENT = 5, 75
#: Bits of a shingle's hash that are exchanged; a collision only keeps a shingle that stands nowhere else.
WIDTH = 40
TILE = 128
#: A shingle in the prefixes of more sets is taken together with a second one.
HOT = 4096
#: Rows of one key are dealt over so many tasks where they meet what is known of the key.
SALTS = 16
SETS_SCHEMA = "doc_id long, n_shingles long, hi long, lo long, tokens binary, prefix int"


class _Shingles:
    """The distinct (shingle, document) of a block, in order of hash, then document."""

    def __init__(self, block: Block, bases: Bases, k: int) -> None:
        words = Words(block, bases, lower=True)
        at = np.flatnonzero(words.left() >= k)
        short = np.flatnonzero((words.count > 0) & (words.count < k))
        a = words.first[:-1][short]
        h = np.concatenate([words.rolling.ranges(at, at + k), mix(words.rolling.ranges(a, a + words.count[short]) + words.count[short].astype(U))])
        doc = np.concatenate([words.doc[at], short])
        order = np.lexsort((doc, h)) if len(short) else np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = h[new], doc[new]
        self.size = np.bincount(self.doc, minlength=len(block.doc_ids))


def _merge_counts(parts: list[tuple[int, int, bytes]]) -> list[bytes]:
    """For each hash of each run, in how many runs it stands, 255 at most."""
    values = np.concatenate([R.unpack_sorted(r, n) for _, n, r in parts])
    order = np.argsort(values)
    ordered = values[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(start, len(ordered)))
    many = np.empty(len(values), np.uint8)
    many[order] = np.repeat(np.minimum(size, 255), size)
    out, at = [], 0
    for _, n, _ in parts:
        out.append(zstandard.ZstdCompressor(level=1).compress(many[at : at + n].tobytes()))
        at += n
    return out


def _need(percent: int, a: int, b: int) -> int:
    """The least overlap that links sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def sets_of(blocks: DataFrame, bases: Bases, k: int, percent: int) -> DataFrame:
    """Every document's set size and signature; for those that may link, the shared shingles in global order and the prefix."""
    stored = blocks.select(F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()[0]
    bits = R.bucket_bits(stored / 2, shuffle_partitions(blocks.sparkSession))

    def send(block: Block, row: dict):
        return R.filter_runs(_Shingles(block, bases, k).hash, bits, WIDTH)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in blocks_of(batches):
            s = _Shingles(block, bases, k)
            _, inverse, local = np.unique(s.hash >> U(64 - WIDTH), return_inverse=True, return_counts=True)
            runs = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(r["reply"]), np.uint8, r["n"]) for r in row["counts"]]) if row["counts"] else np.zeros(len(local), np.uint8)
            shared = ((runs > 1) | (local > 1))[inverse]
            rarity = runs[inverse]
            n = len(block.doc_ids)
            hi, lo = np.zeros(n, U), np.zeros(n, U)
            np.add.at(hi, s.doc, mix(s.hash ^ U(0x1234567)))
            np.add.at(lo, s.doc, mix(s.hash * s.hash + U(77)))
            least = -(-percent * s.size // 100)
            common = np.bincount(s.doc[shared], minlength=n)
            may = (s.size > 0) & (common >= least)
            keep = shared & may[s.doc]
            doc, h, rare = s.doc[keep], s.hash[keep], rarity[keep]
            order = np.lexsort((h, rare, doc))
            doc, h, rare = doc[order], h[order], rare[order]
            stop = np.cumsum(np.bincount(doc, minlength=n))
            tokens, prefix = [None] * n, [None] * n
            for d in np.flatnonzero(may).tolist():
                a, b = int(stop[d - 1]) if d else 0, int(stop[d])
                tokens[d] = h[a:b].tobytes()
                # Shingles that stand nowhere else come first in the order and match nothing.
                prefix[d] = int(s.size[d] - least[d] + 1 - (s.size[d] - (b - a)))
            yield pa.record_batch([pa.array(block.ids(), pa.int64()), pa.array(s.size, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(tokens, pa.binary()), pa.array(prefix, pa.int32())], ["doc_id", "n_shingles", "hi", "lo", "tokens", "prefix"])

    return R.with_replies(blocks, R.exchange(blocks, send, _merge_counts), "counts").mapInArrow(render, SETS_SCHEMA)


# --- the trie ------------------------------------------------------------------------------------


class Trie:
    """Sets in one global order of their tokens, sharing prefixes.

    A node is [children by token, smallest set size below, most tokens that follow it below]; a set that shares its
    path no further is kept as a leaf (its number, where its rest begins).
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.root: list = [{}, 1 << 60, 0]
        self.ended: dict[int, list[int]] = {}
        self.sets: list[tuple[int, list[int]]] = []

    def add(self, size: int, tokens: list[int]) -> None:
        number = len(self.sets)
        self.sets.append((size, tokens))
        self._insert(self.root, number, 0)

    def _insert(self, node: list, number: int, depth: int) -> None:
        size, tokens = self.sets[number]
        while True:
            node[1], node[2] = min(node[1], size), max(node[2], len(tokens) - depth)
            if depth == len(tokens):
                self.ended.setdefault(id(node), []).append(number)
                return
            child = node[0].get(tokens[depth])
            if child is None:
                node[0][tokens[depth]] = (number, depth + 1)
                return
            if isinstance(child, tuple):
                other, rest = child
                child = node[0][tokens[depth]] = [{}, 1 << 60, 0]
                self._place(child, other, rest)
            node, depth = child, depth + 1

    def _place(self, node: list, number: int, depth: int) -> None:
        size, tokens = self.sets[number]
        node[1], node[2] = size, len(tokens) - depth
        if depth == len(tokens):
            self.ended.setdefault(id(node), []).append(number)
        else:
            node[0][tokens[depth]] = (number, depth + 1)

    def any_link(self, size: int, tokens: list[int], where: dict[int, int], has: frozenset) -> int | None:
        """The number of some set that links with this one (``where``: its tokens' places), or None if none does."""
        percent, sets, total = self.percent, self.sets, len(tokens)
        stack = [(self.root, 0, total)]
        while stack:
            node, overlap, mine = stack.pop()
            if overlap + min(node[2], mine) < _need(percent, node[1], size):
                continue
            for number in self.ended.get(id(node), ()):
                if overlap >= _need(percent, sets[number][0], size):
                    return number
            for token, child in node[0].items():
                at = where.get(token)
                o, m = (overlap, mine) if at is None else (overlap + 1, total - at - 1)
                if isinstance(child, list):
                    stack.append((child, o, m))
                    continue
                number, rest = child
                other, theirs = sets[number]
                need = _need(percent, other, size)
                if o + min(len(theirs) - rest, m) >= need and o + len(has.intersection(theirs[rest:])) >= need:
                    return number
        return None


Entry = tuple[int, int, int, list[int]]  # node, component label, set size, tokens


def link_tile(entries: list[Entry], percent: int, apart: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what can be connected among ``entries``; nodes of one label count as connected.

    ``apart``: only sets before and after that place are to be compared.
    """
    sets = UnionFind()
    tries: dict[int, list[Trie]] = {}
    first: dict[int, list[int]] = {}
    out = []
    for place, (node, label, size, tokens) in enumerate(entries):
        if apart is None or place >= apart:
            where, has = {t: i for i, t in enumerate(tokens)}, frozenset(tokens)
            for root in list(tries):
                if sets.find(label) == root or root not in tries:
                    continue
                for trie, nodes in zip(tries[root], first[root], strict=True):
                    hit = trie.any_link(size, tokens, where, has)
                    if hit is not None:
                        out.append((node, nodes[hit]))
                        a, b = sets.find(label), root
                        sets.union(a, b)
                        keep, gone = min(a, b), max(a, b)
                        tries.setdefault(keep, []).extend(tries.pop(gone, []))
                        first.setdefault(keep, []).extend(first.pop(gone, []))
                        break
        if apart is None or place < apart:
            root = sets.find(label)
            if not tries.setdefault(root, []):
                tries[root].append(Trie(percent))
                first.setdefault(root, []).append([])
            tries[root][0].add(size, tokens)
            first[root][0].append(node)
    return out


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of each set's prefix."""
    for batch in batches:
        for node, tokens, n in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
            yield pa.record_batch([pa.array([node] * n, pa.int64()), pa.array(np.frombuffer(tokens, np.int64, n))], ["node", "token"])


def _second_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each hot token of a set's prefix a row for it with each later token of the prefix that is longer by one."""
    for batch in batches:
        for node, tokens, n, hot in zip(*(batch.column(c).to_pylist() for c in ("node", "tokens", "prefix", "hot")), strict=True):
            prefix = np.frombuffer(tokens, np.int64, min(n + 1, len(tokens) // 8)).view(U)
            where = {t: i for i, t in enumerate(prefix.view(np.int64).tolist())}
            for t in hot:
                keys = mix(prefix[where[t] + 1 :] ^ mix(prefix[where[t] : where[t] + 1]))
                yield pa.record_batch([pa.array([node] * len(keys), pa.int64()), pa.array(keys.view(np.int64))], ["node", "token"])


def _meet(rows: DataFrame, known: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with what is known of their ``key``; rows of one key are dealt over ``SALTS`` tasks."""
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def _tile_blob(table: pa.Table) -> bytes:
    rows = zip(table["node"].to_pylist(), table["label"].to_pylist(), table["n_shingles"].to_pylist(), table["tokens"].to_pylist(), strict=True)
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(sorted(rows, key=lambda r: (r[2], r[0]))))


def _entries(blob: bytes) -> list[Entry]:
    return [(node, label, size, np.frombuffer(t, np.int64).tolist()) for node, label, size, t in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


def _links_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["u", "v"])


class JaccardJoin:
    """``components(docs)``: each document's set size and component; see the module."""

    def __init__(self, shingle: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, hot: int = HOT) -> None:
        if not 1 <= percent <= 100:
            raise ValueError("percent must lie between 1 and 100")
        self.shingle, self.percent, self.tile, self.hot = shingle, percent, tile, hot

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, component_id; one row per row of ``docs``."""
        prepare(docs.sparkSession)
        rows = durable(sets_of(durable(pack(docs, id_col, text_col)), draw_bases(), self.shingle, self.percent))
        release_shuffles(docs.sparkSession)
        classes = rows.where("tokens is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix"))
        classes = durable(classes.select(F.monotonically_increasing_id().alias("node"), "*"))
        release_shuffles(docs.sparkSession)
        links = self._links(classes)
        labels = connected_components(links)
        named = classes.select("node", "hi", "lo", "least").join(labels, "node", "left").select("hi", "lo", "least", F.coalesce("label", "node").alias("label"))
        named = durable(named)
        smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
        members = named.join(smallest, "label").select("hi", "lo", "component_id")
        alone = rows.where("tokens is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        grouped = rows.where("tokens is not null").select("doc_id", "n_shingles", "hi", "lo").join(members, ["hi", "lo"], "left").select("doc_id", "n_shingles", "component_id")
        return alone.unionByName(grouped)

    def _postings(self, classes: DataFrame) -> DataFrame:
        """(token, node, hot): the tokens of the classes' prefixes that several have; ``hot``: more than ``self.hot`` do."""
        postings = durable(classes.select("node", "tokens", "prefix").mapInArrow(_prefixes, "node long, token long"))
        shared = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token", (F.col("n") > self.hot).alias("hot"))
        return durable(_meet(postings, shared, "token"))

    @staticmethod
    def _groups(postings: DataFrame) -> DataFrame:
        """(group, node): the classes that share a token with the class ``group`` and with no smaller one."""
        least = postings.groupBy("token").agg(F.min("node").alias("group"), F.count("*").alias("n")).where("n > 1").select("token", "group")
        return durable(_meet(postings, least, "token").select("group", "node").distinct())

    def _links(self, classes: DataFrame) -> DataFrame:
        """Links (u, v) that connect every component of the classes."""
        postings = self._postings(classes)
        cold = self._sets(self._groups(postings.where("not hot")), classes)
        links = self._across(*self._near(cold))
        hot = postings.where("hot")
        if hot.isEmpty():
            return links
        # Most of what a hot token gathers are copies of one another: tiles connect them.
        _, found = self._near(self._sets(self._groups(hot), classes))
        links = durable(links.unionByName(found))
        labels = connected_components(links)
        named = hot.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = named.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("token")
        if apart.isEmpty():
            return links
        # What stays apart under a hot token is looked at by a second one.
        of = _meet(hot, apart, "token").groupBy("node").agg(F.collect_list("token").alias("hot"))
        second = durable(classes.select("node", "tokens", "prefix").join(of, "node").mapInArrow(_second_tokens, "node long, token long"))
        return self._across(*self._near(self._sets(self._groups(second), classes), links))

    @staticmethod
    def _sets(groups: DataFrame, classes: DataFrame) -> DataFrame:
        """The members of groups with their sets and the size of the group."""
        size = groups.groupBy("group").agg(F.count("*").alias("members"))
        return durable(_meet(groups, size, "group").join(classes.select("node", "n_shingles", "tokens"), "node"))

    def _near(self, sets: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The members of groups of several tiles, and links (with those given) that connect what stands in one tile."""
        tile = self.tile
        sets = sets.withColumn("label", F.col("node")) if links is None else self._label(sets.withColumn("label", F.col("node")), links)
        dealt = sets.where("node <> group").withColumn("tile", self._deal("members"))
        # The group's smallest member stands in every tile.
        leaders = sets.where("node = group").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / tile) - 1))).select(dealt.columns)
        found = self._within(dealt.unionByName(leaders))
        links = durable(found if links is None else found.unionByName(links))
        release_shuffles(sets.sparkSession)
        large = sets.where(F.col("members") > tile)
        if large.isEmpty():
            return large, links
        # One member of each component of a tile meets those of the other tiles.
        labelled = self._label(large, links)
        chosen = labelled.withColumn("tile", self._deal("members")).groupBy("group", "tile", "label").agg(F.min("node").alias("node"))
        counted = chosen.groupBy("group").agg(F.count("*").alias("members"))
        again = _meet(chosen.select("group", "node"), counted, "group").join(labelled.drop("members"), ["group", "node"]).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("members") / tile)))
        return large, durable(links.unionByName(self._within(again)))

    def _deal(self, members: str):
        return F.pmod(F.xxhash64("node"), F.ceil(F.col(members) / self.tile))

    @staticmethod
    def _label(sets: DataFrame, links: DataFrame) -> DataFrame:
        labels = connected_components(links)
        return durable(sets.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))

    def _within(self, sets: DataFrame) -> DataFrame:
        percent = self.percent

        def join(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["n_shingles"].to_pylist(), table["node"].to_pylist(), table["label"].to_pylist(), table["tokens"].to_pylist(), strict=True))
            return _links_table(link_tile([(n, lab, s, np.frombuffer(t, np.int64).tolist()) for s, n, lab, t in rows], percent))

        return sets.select("group", "tile", "node", "label", "n_shingles", "tokens").groupBy("group", "tile").applyInArrow(join, "u long, v long")

    def _across(self, sets: DataFrame, links: DataFrame) -> DataFrame:
        """``links``, and those between components of a group that has several, by pairs of tiles that hold different ones."""
        if sets.isEmpty():
            return links
        percent, tile = self.percent, self.tile
        sets = self._label(sets, links)
        several = sets.groupBy("group", "label").agg(F.count("*").alias("own"))
        open_groups = several.groupBy("group").agg(F.count("*").alias("labels")).where("labels > 1").select("group")
        sets = _meet(sets, open_groups, "group").withColumn("_key", F.struct("group", "label"))
        sets = _meet(sets, several.select(F.struct("group", "label").alias("_key"), "own"), "_key").drop("_key")
        # A component of half a tile or more has tiles of its own; the small ones share tiles.
        home = F.when(F.col("own") * 2 >= tile, F.col("label")).otherwise(F.lit(-1))
        sets = sets.withColumn("home", home)
        sets = sets.withColumn("_key", F.struct("group", "home"))
        homes = sets.groupBy("_key").agg(F.count("*").alias("in_home"))
        sets = _meet(sets, homes, "_key").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(11)), F.ceil(F.col("in_home") / tile)))

        def blob(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            group, home_, tile_ = (k.as_py() for k in key)
            return pa.table([pa.array([group], pa.int64()), pa.array([home_], pa.int64()), pa.array([tile_], pa.int64()), pa.array([_tile_blob(table)], pa.binary())], ["group", "home", "tile", "blob"])

        tiles = durable(sets.select("group", "home", "tile", "node", "label", "n_shingles", "tokens").groupBy("group", "home", "tile").applyInArrow(blob, "group long, home long, tile long, blob binary"))
        # Of two tiles that meet, one is dealt over the tasks, the other stands in all of them.
        salt = F.pmod(F.xxhash64("home", "tile"), F.lit(SALTS)).cast("int")
        a = tiles.withColumn("salt", salt).alias("a")
        b = tiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("b")
        ahead = (F.col("a.home") < F.col("b.home")) | ((F.col("a.home") == F.col("b.home")) & (F.col("a.home") == -1) & (F.col("a.tile") <= F.col("b.tile")))
        pairs = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.salt") == F.col("b.salt")) & ahead).select(F.col("a.blob").alias("x"), F.col("b.blob").alias("y"), (F.col("a.home") == F.col("b.home")).alias("mixed"), (F.col("a.tile") == F.col("b.tile")).alias("same"))
        pairs = pairs.repartition(max(shuffle_partitions(tiles.sparkSession), 8))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x = _entries(batch.column("x")[i].as_py())
                    if batch.column("mixed")[i].as_py() and batch.column("same")[i].as_py():
                        links = link_tile(x, percent)
                    else:
                        links = link_tile(x + _entries(batch.column("y")[i].as_py()), percent, apart=len(x))
                    if links:
                        yield from _links_table(links).to_batches()

        return durable(pairs.mapInArrow(join, "u long, v long").unionByName(links))
