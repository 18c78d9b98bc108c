"""N-gram Jaccard join by prefixes of token combinations.

A document's tokens are its distinct word shingles. Tokens have one global order: rare ones first, by hash, then the
frequent ones by rising document count. A document that may miss ``t`` of its tokens in a partner indexes a prefix:

* rare tokens each on their own, ``t + 1`` of them if it has as many;
* otherwise all of them, and frequent tokens in pairs. Frequent tokens fall into subsets by hash, and a pair is two
  tokens of one subset. The prefix is extended until the numbers of rare tokens and, per subset, of frequent tokens
  minus one reach ``t + 1``: losing any ``t`` tokens then leaves a whole signature, so linked documents share one. The
  number of subsets goes with the size of the documents, and a document indexes for both sizes its partners can have.

Documents that share a signature are candidates. Verification compares whole token sets. As only the classes
are wanted, candidates are met in two rounds: first each member of a signature with the smallest one (hot signatures are
salted, and the salts' smallest meet again), then, where members of a signature are still apart, all
documents led by the same one, in blocks: signatures and sizes rule out most pairs for good, and whole token sets
decide the others. Nothing is sampled or capped.

Token counts cover all documents; they choose the order and the classes and never change the result. At most
``FREQUENT_TOKENS`` tokens are called frequent, the most frequent ones, which bounds the table that is sent to the tasks.

Null text, empty text and text without words: no shingle, no link, a component of its own. Equal sets are one class
before any indexing. Rows with a null id have a null component. An id with several texts is one node: its rows share a
component. Repeated rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlab.llm.common import checked, chunks, mix, ragged, tidy, utf8, word_hashes, word_table
from pitlab.llm.components import components, forest
from pitlab.session import materialize

FREQUENT_FROM = 64
FREQUENT_TOKENS = 1 << 20
SALTS = 64
_BLOCK, _BLOCK_TOKENS, _FEW, _COLUMNS = 384, 1 << 20, 4, 4096
#: Bits of the table that tells which documents take part in a verification. It lets others pass by chance only.
PRESENCE_BITS = 20
SPACES = word_table([(0x20, 0x20), (0x09, 0x0D)])
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)]
_KEPT = 40  # bits of a token that a slice stores
_PER_SLICE = 1 << 20  # tokens that a task gathers before it sends them
_PER_SLICE_AT_ONCE = 1 << 22  # tokens that meet in one slice, about


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than ``size`` are one shingle."""
    hashes, first = word_hashes(raw, offsets, SPACES)
    n = max(len(hashes) - size + 1, 0)
    rolled = np.full(n, np.uint64(size))
    for k in range(size):
        rolled += mix(hashes[k : k + n] ^ _SEEDS[k % 8]) * _SEEDS[(k + 1) % 8] if k >= 8 else hashes[k : k + n] * _SEEDS[k]
    rolled = mix(rolled)
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - begin >= size:
            ordered = np.sort(rolled[begin : end - size + 1])
            yield ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]
        elif end > begin:
            short = np.full(1, end - begin, np.uint64)
            for k in range(begin, end):
                short = mix(short * _SEEDS[7] + hashes[k : k + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)


def column_shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    raw, offsets = utf8(column)
    for low, high in chunks(offsets):
        yield from shingles(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)


def _prints(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, h1, h2): the size of each set and two hashes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ _SEEDS[4]).sum(dtype=np.uint64))) for s in column_shingles(batch.column("text"), size)]
            made = np.array(rows, np.uint64).reshape(-1, 3).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(made[:, k]) for k in range(3))], names=["doc_id", "n", "h1", "h2"])

    return documents.mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long")


def _token_counts(documents: DataFrame, size: int, slices: int) -> DataFrame:
    """(token, df): document counts of all tokens that at least ``FREQUENT_FROM`` documents have.

    A token is known by its leading bits: those of its slice and ``_KEPT`` more. A task sends each slice the tokens of
    many documents as one block of sorted bytes, five a token, and repeats only as counts.
    """
    shift = np.uint64(64 - _KEPT - (slices - 1).bit_length())

    def block(tokens: np.ndarray) -> bytes:
        low = (tokens & np.uint64((1 << _KEPT) - 1)).astype("<u8")
        return low.view(np.uint8).reshape(-1, 8)[:, : _KEPT // 8].tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held) >> shift, return_counts=True)
            edges = np.searchsorted(tokens >> np.uint64(_KEPT), np.arange(slices + 1, dtype=np.uint64))
            once, more, extra = [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                repeated = times[a:b] > 1
                once.append(block(tokens[a:b][~repeated]))
                more.append(block(tokens[a:b][repeated]))
                extra.append(times[a:b][repeated].astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int64()), *(pa.array(x, pa.binary()) for x in (once, more, extra))], names=["slice", "once", "more", "times"])

        for batch in batches:
            for tokens in column_shingles(batch.column("text"), size):
                held.append(tokens)
                count += len(tokens)
                if count >= _PER_SLICE:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def unblock(data: bytes) -> np.ndarray:
        wide = np.zeros((len(data) // (_KEPT // 8), 8), np.uint8)
        wide[:, : _KEPT // 8] = np.frombuffer(data, np.uint8).reshape(-1, _KEPT // 8)
        return wide.reshape(-1).view("<u8")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for k, once, more, times in zip(*(batch.column(c).to_pylist() for c in ("slice", "once", "more", "times")), strict=True):
                single, repeated = unblock(once), unblock(more)
                held.setdefault(k, []).append((np.concatenate((single, repeated)), np.concatenate((np.ones(len(single), np.int64), np.frombuffer(times, "<i8")))))
        for k, parts in held.items():
            tokens, times = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
            order = np.argsort(tokens)
            tokens, times = tokens[order], times[order]
            heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
            total = np.add.reduceat(times, heads) if len(heads) else np.zeros(0, np.int64)
            kept = total >= FREQUENT_FROM
            yield pa.RecordBatch.from_arrays([pa.array((np.uint64(k) << np.uint64(_KEPT) | tokens[heads][kept]).astype(np.int64)), pa.array(total[kept])], names=["token", "df"])

    blocks = documents.mapInArrow(tidy(pack), "slice long, once binary, more binary, times binary")
    return blocks.repartition(slices, "slice").mapInArrow(tidy(count), "token long, df long")


def missable(n: int, percent: int) -> int:
    """How many of ``n`` tokens a linked document may lack."""
    return n - -(-percent * n // 100)


class Signatures:
    """The signatures of a token set under one global order: even ones of rare tokens, odd ones of pairs."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, shift: int, percent: int) -> None:
        order = np.argsort(tokens)
        self.tokens, self.counts, self.shift, self.percent = tokens[order], counts[order], np.uint64(shift), percent

    def of(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        need = missable(n, self.percent) + 1
        if not n:
            return tokens
        if len(self.tokens):
            short = tokens >> self.shift
            at = np.minimum(np.searchsorted(self.tokens, short), len(self.tokens) - 1)
            frequent = self.tokens[at] == short
        else:
            at, frequent = np.zeros(n, np.int64), np.zeros(n, bool)
        rare = tokens[~frequent]
        if len(rare) >= need:
            return mix(rare[:need]) & ~np.uint64(1)
        many, df = tokens[frequent], self.counts[at[frequent]]
        many = many[np.lexsort((many, df))]
        least, most = -(-self.percent * n // 100), 100 * n // self.percent
        found = [mix(rare) & ~np.uint64(1)]
        for level in range(least.bit_length(), most.bit_length() + 1):
            found.append(self._pairs(many, need - len(rare), max(1, (1 << level - 1) // 4)))
        return np.unique(np.concatenate(found))

    @staticmethod
    def _pairs(many: np.ndarray, need: int, subsets: int) -> np.ndarray:
        """Pairs within subsets, of the shortest prefix that ``need`` lost tokens cannot empty of pairs."""
        subset = (mix(many ^ _SEEDS[5]) % np.uint64(subsets)).astype(np.int64)
        _, first = np.unique(subset, return_index=True)
        spare = np.ones(len(many), np.int64)
        spare[first] = 0  # the first of a subset makes no pair yet
        size = int(np.searchsorted(np.cumsum(spare), need)) + 1
        chosen, subset = many[:size], subset[:size]
        order = np.lexsort((chosen, subset))
        chosen, subset = chosen[order], subset[order]
        found, gap = [], 1
        while gap < len(chosen):
            same = subset[gap:] == subset[:-gap]
            if not same.any():
                break
            found.append(mix(chosen[:-gap][same] * _SEEDS[6] + mix(chosen[gap:][same])) | np.uint64(1))
            gap += 1
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _signatures(documents: DataFrame, frequent: pa.Table, slices: int, size: int, percent: int) -> DataFrame:
    """(doc_id, n, rare, signatures) of every document: ``rare`` of the signatures are single tokens."""
    shift = 64 - _KEPT - (slices - 1).bit_length()
    table = (frequent.column("token").to_numpy().astype(np.uint64), frequent.column("df").to_numpy())
    shared = documents.sparkSession.sparkContext.broadcast(table)  # at most FREQUENT_TOKENS rows of 16 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(*shared.value, shift, percent)
        for batch in batches:
            sets = [(len(s), signatures.of(s)) for s in column_shingles(batch.column("text"), size)]
            data = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for _, x in sets]))), pa.int32()), pa.array(np.concatenate([x for _, x in sets] or [np.zeros(0, np.uint64)]).view(np.int64)))
            rare = [int((x & np.uint64(1) == 0).sum()) for _, x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in sets], pa.int64()), pa.array(rare, pa.int64()), data], names=["doc_id", "n", "rare", "signatures"])

    return documents.mapInArrow(tidy(run), "doc_id long, n long, rare long, signatures array<long>")


def _fits(a: str, b: str, percent: int) -> str:
    return f"100L * LEAST({a}, {b}) >= {percent}L * GREATEST({a}, {b})"


def _token_sets(documents: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, tokens) of the documents in ``ids``, made again from their texts.

    At most ``2 ** PRESENCE_BITS`` hash places of the ids are broadcast; they keep nearly all other documents from being
    read further, and the join on the ids drops the rest.
    """
    place = f"pmod(xxhash64(doc_id), {1 << PRESENCE_BITS}L) AS place"
    ids = materialize(ids.select("doc_id").distinct(), "wanted-ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [s.tobytes() for s in column_shingles(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "tokens"])

    wanted = documents.selectExpr("doc_id", "text", place).join(F.broadcast(ids.selectExpr(place).distinct()), "place", "left_semi").select("doc_id", "text")
    return wanted.mapInArrow(tidy(sets), "doc_id long, tokens binary").join(ids, "doc_id", "left_semi")


def _verified(documents: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    made = materialize(_token_sets(documents, ids, size), "token-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for left, right in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                ordered = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((ordered[1:] == ordered[:-1]).sum())
                similar.append(100 * common >= percent * (len(x) + len(y) - common) > 0)
            keep = pa.array(np.flatnonzero(np.array(similar, bool)))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    with_b = pairs.join(made.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    return with_b.join(made.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    spread = np.diff(np.append(heads, len(tokens)))
    common = np.zeros((n, n), np.float32)
    # Tokens of few sets pair by pair, the others as columns of a product.
    few = (spread > 1) & (spread <= _FEW)
    for count in np.unique(spread[few]):
        rows = owner[heads[few & (spread == count)][:, None] + np.arange(count)]
        for x in range(count):
            for y in range(count):
                if x != y:
                    np.add.at(common, (rows[:, x], rows[:, y]), 1)
    many = np.flatnonzero(spread > _FEW)
    for low in range(0, len(many), _COLUMNS):
        part = many[low : low + _COLUMNS]
        held = np.zeros((n, len(part)), np.float32)
        held[owner[ragged(heads[part], spread[part])], np.repeat(np.arange(len(part)), spread[part])] = 1
        common += held @ held.T
    return common


def _in_blocks(groups: DataFrame, weight: str, most: int) -> DataFrame:
    """``groups`` with block numbers (i, j): each two rows of a ``top`` meet in some block pair of bounded weight."""
    sizes = groups.groupBy("top").agg(F.ceil(F.greatest(F.count("*") / _BLOCK, F.sum(weight) / most)).cast("long").alias("blocks"))
    rows = groups.join(sizes, "top").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "own", "other")


def _each_block(rows: DataFrame, columns: list[str], compare: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """``compare`` over the rows of each block pair, its columns as lists of one kind of array per batch."""
    placed = rows.select("top", "i", "j", *columns).repartition("top", "i", "j").sortWithinPartitions("top", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("top", "i", "j")])
            edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(batch)]))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[:, low].tolist())
                if key != now and held:
                    yield compare(now[0], pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(low, high - low))
        if held:
            yield compare(now[0], pa.Table.from_batches(held))

    return placed.mapInArrow(tidy(run), schema)


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _possible(pairs: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bound of ``_hopeful`` lets link; ``listed`` has rep, n, rare and held signatures."""
    part = listed.select("rep", "n", "rare", F.col("held.sig").alias("sigs"))
    sides = [part.select(*(F.col(c).alias(f"{c}_{x}" if c != "rep" else x) for c in part.columns)) for x in "ab"]
    both = pairs.join(sides[1], "b").join(sides[0], "a")
    plain = {x: f"NOT exists(sigs_{x}, s -> s & 1 = 1)" for x in "ab"}
    rest = {x: f"(n_{x} - rare_{x})" for x in "ab"}
    more = f"CASE WHEN {plain['a']} AND {plain['b']} THEN GREATEST({rest['a']}, {rest['b']}) WHEN {plain['a']} THEN {rest['a']} WHEN {plain['b']} THEN {rest['b']} ELSE LEAST({rest['a']}, {rest['b']}) END"
    common = "size(filter(array_intersect(sigs_a, sigs_b), s -> s & 1 = 0))"
    return both.where(f"{_fits('n_a', 'n_b', percent)} AND {100 + percent} * ({common} + {more}) >= {percent} * (n_a + n_b)").select("a", "b")


def _hopeful(groups: DataFrame, percent: int) -> DataFrame:
    """The rows (top, rep) of ``groups`` (top, rep, n, rare, c, sigs) that may link to another component of their group.

    Tokens that two documents share beyond their common signatures can only stand behind a prefix, so the signatures
    and sizes give an upper bound of what they share; a pair whose bound is too small is left out for good.
    """

    def compare(top: int, table: pa.Table) -> pa.RecordBatch:
        ids, comps, n, rare = _numbers(table, "rep", "c", "n", "rare")
        held = [np.array(x, np.int64) for x in table.column("sigs").to_pylist()]
        plain = np.array([not (x & 1).any() for x in held])
        common = _overlaps([x[x & 1 == 0] for x in held])
        rest = (n - rare).astype(np.float64)
        both, neither = np.logical_and.outer(plain, plain), np.logical_and.outer(~plain, ~plain)
        # One plain: the bound is that document's rest. Neither: only frequent tokens are left to share.
        mixed = np.where(plain[:, None], rest[:, None], rest[None, :])
        bound = common + np.where(both, np.maximum.outer(rest, rest), np.where(neither, np.minimum.outer(rest, rest), mixed))
        total = np.add.outer(n, n)
        fits = 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
        open_ = ((100 + percent) * bound >= percent * total) & fits & np.not_equal.outer(comps, comps)
        found = ids[open_.any(axis=1)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), top)), pa.array(found)], names=["top", "rep"])

    rows = _in_blocks(groups.withColumn("held", F.size("sigs")), "held", _BLOCK_TOKENS)
    return _each_block(rows, ["rep", "c", "n", "rare", "sigs"], compare, "top long, rep long").distinct()


def _within_groups(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is similar within each group of ``groups`` (top, rep, n, c).

    A group is cut into blocks; a task compares all sets of two blocks and sends back at most one link a document. Pairs that
    are in one component already tell nothing new.
    """

    def compare(top: int, table: pa.Table) -> pa.RecordBatch:
        ids, comps = _numbers(table, "doc_id", "c")
        held = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        counts = np.array([len(x) for x in held], np.int64)
        common = _overlaps(held).astype(np.int64)
        linked = 100 * common >= percent * (counts[:, None] + counts[None, :] - common)
        a, b = np.nonzero(linked & np.not_equal.outer(comps, comps) & np.less.outer(ids, ids))
        node, root = forest(ids[a], ids[b])
        return pa.RecordBatch.from_arrays([pa.array(root), pa.array(node)], names=["a", "b"])

    rows = _in_blocks(groups, "n", _BLOCK_TOKENS).withColumnRenamed("rep", "doc_id").join(sets, "doc_id")
    return _each_block(rows, ["doc_id", "c", "tokens"], compare, "a long, b long")


def similar_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = materialize(_prints(docs, size), "set-prints")
    classes = prints.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "set-classes")

    total = prints.agg(F.sum("n")).first()[0] or 0
    slices = 1 << max(6, (total // _PER_SLICE_AT_ONCE).bit_length())
    counts = materialize(_token_counts(docs.where("doc_id IS NOT NULL"), size, slices), "token-counts")
    frequent = counts.orderBy(F.desc("df"), "token").limit(FREQUENT_TOKENS).toArrow()

    held = _signatures(docs.where("doc_id IS NOT NULL"), frequent, slices, size, percent)
    reps = checked(classes.select(F.col("rep").alias("doc_id")).distinct())
    postings = held.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", "rare", F.explode("signatures").alias("sig"))
    odd = F.col("sig").bitwiseAND(F.lit(1)) == 1
    salted = postings.withColumn("salt", F.when(odd, F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = Window.partitionBy("sig", "salt")
    led = salted.withColumn("lead", F.min("rep").over(salts)).withColumn("members", F.count("*").over(salts)).where((F.col("members") > 1) | odd)
    led = materialize(led.select("sig", "rep", "n", "rare", "lead"), "led-signatures")
    tops = led.where((F.col("rep") == F.col("lead")) & odd).select("sig", "lead").distinct().withColumn("top", F.min("lead").over(Window.partitionBy("sig")))
    tops = materialize(tops, "signature-tops")
    # Each document with its shared signatures and the smallest document of each.
    paired = led.where(odd).join(tops, ["sig", "lead"])
    shared = led.where(~odd).withColumnRenamed("lead", "top").unionByName(paired.drop("lead"))
    listed = shared.groupBy("rep").agg(F.max("n").alias("n"), F.max("rare").alias("rare"), F.collect_set(F.struct("sig", "top")).alias("held"))
    listed = materialize(listed, "listed-signatures")

    # First round: each member with the smallest one of its salt, and the salts' smallest with the smallest of all.
    inner = led.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    outer = tops.where("lead != top").select(F.col("top").alias("a"), F.col("lead").alias("b"))
    pairs = _possible(inner.unionByName(outer).distinct(), listed, percent)
    links = materialize(_verified(docs, materialize(pairs, "tried-pairs"), size, percent).distinct(), "links-first")

    # Second round: documents of signatures that still join several components.
    grouped = components(links)
    placed = listed.join(grouped.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    placed = materialize(placed.select("rep", "n", "rare", "c", "held"), "placed-signatures")
    each = placed.select("rep", "c", F.inline("held"))
    # A frequent signature's rows are spread by salt: its extremes are taken by salt, then of the salts, and told to each salt.
    salted = each.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    ends = salted.groupBy("sig", "salt").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    split = ends.groupBy("sig").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("sig")
    apart = salted.join(ends.select("sig", "salt").join(split, "sig"), ["sig", "salt"], "left_semi").select("top", "rep").distinct()
    groups = materialize(apart.join(placed.select("rep", "n", "rare", "c", F.col("held.sig").alias("sigs")), "rep"), "open-groups")
    hopeful = materialize(groups.drop("sigs").join(_hopeful(groups, percent), ["top", "rep"]), "hopeful")
    sets = materialize(_token_sets(docs, hopeful.select(F.col("rep").alias("doc_id")), size), "token-sets")
    more = materialize(_within_groups(hopeful, sets, percent).distinct(), "links-second")

    copies = prints.join(classes, ["n", "h1", "h2"]).where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    whole = components(links.unionByName(more).unionByName(copies))
    rows = prints.join(whole.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
