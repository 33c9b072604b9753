"""Phrase collocations: n-grams counted in burst tries that spill sorted runs, then scored by their weakest cut.

Counting. Each task keeps a HAT-trie: a shallow trie by language and word ids whose leaves are hash containers from the rest of a phrase to its
count. A container that grows too large bursts into one child for each next word; containers stop bursting while a phrase still has a word
left. When the trie holds too many entries, whole subtrees are spilled as sorted runs, those of the rarest phrases first. A run's rows carry the bucket of their
prefix (language and first word). Runs are merged per prefix partition: Spark brings the rows of a partition together and adds them up; a prefix with
more rows than a partition should have is dealt over several partitions by the whole phrase.

Nothing is counted that cannot be frequent, and nothing that can is left out: a phrase is at most as frequent as the words and pairs in
it. Words are counted first. Pairs of frequent words are then counted by hash alone, in a fixed number of cells; a pair is at most as frequent as its cell.
Last, phrases all of whose pairs lie in frequent cells are counted as such. Both sieves go to the tasks as bitmaps of fixed size: a collision lets a
phrase be counted in vain, never the other way round. Texts are split once, into written chunks of word ids with their dictionaries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hookflow.llm.common import discard, mix, pieces, utf8, written
from hookflow.session import broadcast_if_small

LONGEST = 5  # words in a phrase
LEAST = 100  # occurrences of a candidate
TOP = 2000  # phrases of a language
UNKNOWN = "und"  # language of rows without one

BURST_ENTRIES = 1 << 13  # of a container
TRIE_ENTRIES = 1 << 18  # of a task's trie before subtrees are spilled; about 50 MB
WORDS_KNOWN = 1 << 18  # of a task before it spills all and starts its word ids anew
CHUNK_WORDS = 1 << 16  # of a chunk, which is then a row of some 200 KB; a longer text makes a longer one
WORD_BITS = 1 << 26  # of the bitmap of frequent words: 8 MB, whatever the input
PAIR_BITS = 1 << 28  # of the bitmap of cells with frequent pairs: 32 MB, whatever the input
_WORD_BLOCK = 1 << 15  # bits that bitmap_construct_agg puts in a row
_PAIR_BLOCK = 1 << 16  # cells that are counted together
CELLS_AT_ONCE = 1 << 20  # pairs of a task that are sorted by cell at once
PREFIX_BUCKETS = 1 << 12  # a bucket with more than its even share of the rows is dealt out by phrase
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_BREAK = b"."  # stands for a break between pieces; no word can be one
_PAIR = np.uint64(0x9E3779B97F4A7C15)
RUN_LAYOUT = "lang string, phrase string, n long"
CHUNK_LAYOUT = "ids binary, text_langs binary, text_sizes binary, words binary, langs array<string>"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with a break after each piece."""
    return (text.lower().translate(_BREAKS).replace(b"\n", b" . ") + b" .").split()


class _Names(dict):
    """Ids of words or languages by first occurrence."""

    def __init__(self, *names: bytes):
        self.listed: list[bytes] = []
        for name in names:
            self[name]

    def __missing__(self, name: bytes) -> int:
        number = self[name] = len(self.listed)
        self.listed.append(name)
        return number


class HatTrie:
    """Counts of id sequences: nodes by leading ids, and hash containers for the rest."""

    def __init__(self, depth: int, burst: int = BURST_ENTRIES):
        self.root: dict | Counter = Counter()
        self.depth, self.burst, self.entries = depth, burst, 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Counts rows of big-endian ids, or adds their counts; all have the same number of ids, more than the trie's depth."""
        if len(keys):
            self.root = self._add(self.root, keys, counts, 0)

    def _add(self, node: dict | Counter, keys: np.ndarray, counts: np.ndarray | None, depth: int) -> dict | Counter:
        if isinstance(node, Counter):
            before = len(node)
            rest = np.ascontiguousarray(keys)
            listed = rest.view(f"V{4 * rest.shape[1]}").ravel().tolist()
            if counts is None:
                node.update(listed)
            else:
                for key, n in zip(listed, counts.tolist(), strict=True):
                    node[key] += n
            self.entries += len(node) - before
            return self._burst(node) if len(node) > self.burst and depth < self.depth else node
        order = np.argsort(keys[:, 0], kind="stable")
        heads = keys[order, 0]
        rest = keys[order, 1:]
        ordered = None if counts is None else counts[order]
        cuts = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), len(heads)]
        for start, end in zip(cuts, cuts[1:]):
            head = int(heads[start])
            below = None if ordered is None else ordered[start:end]
            node[head] = self._add(node[head] if head in node else Counter(), rest[start:end], below, depth + 1)
        return node

    @staticmethod
    def _burst(container: Counter) -> dict:
        children: dict[int, Counter] = {}
        for key, n in container.items():
            children.setdefault(int.from_bytes(key[:4], "big"), Counter())[key[4:]] = n
        return children

    def subtrees(self) -> list[tuple[tuple[int, ...], dict | Counter, int]]:
        """(path, node, entries) of the containers and of the nodes right above them."""
        found = []

        def walk(node, path):
            if isinstance(node, Counter):
                found.append((path, node, len(node)))
            else:
                for head, child in node.items():
                    walk(child, (*path, head))

        walk(self.root, ())
        return found

    def spill(self, keep: int) -> list[tuple[tuple[int, ...], Counter]]:
        """Takes whole subtrees out until at most ``keep`` entries are left, those first whose entries were met least often; each comes as
        (path, container)."""
        taken = []
        for path, container, size in sorted(self.subtrees(), key=lambda s: sum(s[1].values()) / max(1, s[2])):
            if self.entries <= keep:
                break
            taken.append((path, container))
            self.entries -= size
            if not path:
                self.root = Counter()
                continue
            node = self.root
            for head in path[:-1]:
                node = node[head]
            del node[path[-1]]
        return taken


def _hashed(langs: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(langs ^ words)


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The cells of pairs, from the hashes of a word of a language and of the next word."""
    return mix(first * _PAIR + second) & np.uint64(PAIR_BITS - 1)


def _held(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as chunks of word ids; each chunk has its own dictionary, in which id 0 is the break."""

    def chunk() -> pa.RecordBatch:
        ids = np.concatenate(held).astype("<u2" if len(words) <= 1 << 16 else "<u4")
        cells = [ids.tobytes(), np.array(text_langs, "<i4").tobytes(), np.array([len(x) for x in held], "<i4").tobytes(), b" ".join(words.listed)]
        arrays = [pa.array([c], pa.binary()) for c in cells]
        names = [x.decode() for x in langs.listed]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([names], pa.list_(pa.string()))], [c.split()[0] for c in CHUNK_LAYOUT.split(", ")])

    words, langs, held, text_langs, size = _Names(_BREAK), _Names(), [], [], 0
    for batch in pieces(batches):
        for lang, text in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
            found = words_of(text or b"")
            held.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            text_langs.append(langs[lang])
            size += len(found)
            if size >= CHUNK_WORDS:
                yield chunk()
                words, langs, held, text_langs, size = _Names(_BREAK), _Names(), [], [], 0
    if held:
        yield chunk()


class _Chunk:
    """A chunk read back: word ids with breaks, and of every place the language."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        text_langs, sizes = (np.frombuffer(batch.column(i)[row].as_buffer(), "<i4") for i in (1, 2))
        ids = batch.column(0)[row].as_buffer()
        self.ids = np.frombuffer(ids, f"<u{ids.size // max(1, int(sizes.sum()))}" if ids.size else "<u2")
        self.words = batch.column(3)[row].as_py().split(b" ")
        self.langs = [x.encode() for x in batch.column(4)[row].as_py()]
        self.lang = np.repeat(text_langs, sizes)
        word_hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        lang_hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.langs), np.uint64, len(self.langs))
        self.after = word_hashes[self.ids]
        self.hashes = _hashed(lang_hashes[self.lang], self.after)

    def linked(self, frequent_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a frequent word stands at a place, and whether the next place holds one of the same piece too."""
        # Texts end with a break, so no pair reaches into another text.
        inside = (self.ids != 0) & _held(frequent_words, self.hashes & np.uint64(WORD_BITS - 1))
        return inside, inside[:-1] & inside[1:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield _Chunk(batch, row)


def _cells(frequent_words):
    """Cells of the pairs of frequent words, in blocks: (block, sorted places in it, each as often as it came)."""

    def told(cells: np.ndarray, least: int) -> pa.RecordBatch:
        cells, n = np.unique(cells, return_counts=True)
        # What comes ``least`` times is frequent already.
        cells = np.repeat(cells, np.minimum(n, least))
        block = cells // _PAIR_BLOCK
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        places = np.split((cells % _PAIR_BLOCK).astype("<u2"), starts[1:])
        return pa.RecordBatch.from_arrays([pa.array(block[starts].astype(np.int64)), pa.array([p.tobytes() for p in places], pa.binary())], ["block", "places"])

    def run(least: int):
        def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for chunk in _chunks(batches):
                _, linked = chunk.linked(frequent_words.value)
                held.append(_paired(chunk.hashes[:-1][linked], chunk.after[1:][linked]).astype(np.uint32))
                size += len(held[-1])
                if size >= CELLS_AT_ONCE:
                    yield told(np.concatenate(held), least)
                    held, size = [], 0
            if size:
                yield told(np.concatenate(held), least)

        return cells_of

    return run


def _frequent_cells(least: int):
    """Blocks of cells, sorted by block, as bitmaps of the cells with at least ``least`` pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n = None, np.zeros(_PAIR_BLOCK, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            if current is not None and (n >= least).any():
                bits = np.packbits(n >= least, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([bits], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != current:
                    yield from told()
                    current, n = block, np.zeros(_PAIR_BLOCK, np.int64)
                n += np.bincount(np.frombuffer(places.as_buffer(), "<u2"), minlength=_PAIR_BLOCK)
        yield from told()

    return run


def _bitmap(rows: list, size: int) -> np.ndarray:
    """Rows (block, bits) as one bitmap of ``size`` bits, which bounds what comes to the driver."""
    bits = np.zeros(size // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(row["bits"], np.uint8)
        bits[row["block"] * len(part) : (row["block"] + 1) * len(part)] = part
    return bits


class _Counting:
    """A task's counts of phrases of some lengths."""

    def __init__(self, lengths: tuple[int, ...], words: np.ndarray | None, pairs: np.ndarray | None):
        self.lengths, self.frequent_words, self.frequent_pairs = lengths, words, pairs
        self.langs = _Names()
        self._forget()

    def _forget(self) -> None:
        self.words, self.trie = _Names(), HatTrie(min(self.lengths))

    def add(self, chunk: _Chunk) -> None:
        ids = np.fromiter(map(self.words.__getitem__, chunk.words), np.int64, len(chunk.words))[chunk.ids]
        lang = np.fromiter(map(self.langs.__getitem__, chunk.langs), np.int64, len(chunk.langs))[chunk.lang]
        whole = chunk.ids != 0
        if self.lengths == (1,):
            keys, n = np.unique((lang[whole] << 32) | ids[whole], return_counts=True)
            self.trie.add(np.stack((keys >> 32, keys & 0xFFFFFFFF), axis=1).astype(">u4"), n)
            return
        if self.frequent_words is not None:
            whole, linked = chunk.linked(self.frequent_words)
        else:
            linked = whole[:-1] & whole[1:]
        if self.frequent_pairs is not None:
            at = np.flatnonzero(linked)
            linked = np.zeros(len(linked), bool)
            linked[at] = _held(self.frequent_pairs, _paired(chunk.hashes[at], chunk.after[at + 1]))
        for k in range(1, max(self.lengths) + 1):
            if k > 1:
                whole = whole[: len(ids) - k + 1] & linked[k - 2 :]
            if k in self.lengths:
                at = np.flatnonzero(whole)
                keys = np.empty((len(at), k + 1), ">u4")
                keys[:, 0] = lang[at]
                for i in range(k):
                    keys[:, i + 1] = ids[at + i]
                self.trie.add(keys)

    def run(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Spilled subtrees as sorted runs."""
        by_length: dict[int, list[bytes]] = {}
        counts: dict[int, list[int]] = {}
        for path, container in self.trie.spill(keep):
            head = b"".join(x.to_bytes(4, "big") for x in path)
            for key, n in sorted(container.items()):
                length = (len(head) + len(key)) // 4 - 1
                by_length.setdefault(length, []).append(head + key)
                counts.setdefault(length, []).append(n)
        for length, keys in by_length.items():
            yield from self._rows(length, np.frombuffer(b"".join(keys), ">u4").reshape(-1, length + 1).astype(np.int64), np.array(counts[length], np.int64))

    def _rows(self, length: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        listed = pa.array(self.words.listed, pa.binary())
        names = pa.array([x.decode() for x in self.langs.listed], pa.string())
        for start in range(0, len(keys), 1 << 16):
            part = slice(start, start + (1 << 16))
            words = [listed.take(pa.array(keys[part, i])) for i in range(1, length + 1)]
            phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())) if length > 1 else words[0]
            columns = [names.take(pa.array(keys[part, 0])), phrase.view(pa.string()), pa.array(counts[part])]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUN_LAYOUT.split(", ")])

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            self.add(chunk)
            if len(self.words) > WORDS_KNOWN:
                yield from self.run(0)
                self._forget()
            elif self.trie.entries > TRIE_ENTRIES:
                yield from self.run(TRIE_ENTRIES // 2)
        yield from self.run(0)


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))


def chunks(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` as written chunks of word ids."""
    texts = docs.select(_lang().alias("lang"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(_split, CHUNK_LAYOUT), "chunks")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 1)), F.lit(PREFIX_BUCKETS)).cast("int")


def counts(texts: DataFrame, lengths: tuple[int, ...], words=None, pairs=None, heads: DataFrame | None = None) -> DataFrame:
    """lang, phrase, n: how often phrases of the lengths come in the ``chunks`` of a language.

    With ``words`` and ``pairs``, broadcast bitmaps, phrases with words or pairs that are not in them are left out. ``heads``, the words that
    phrases begin with (lang, phrase, n), tell how many rows a prefix may have.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _Counting(lengths, *(x.value if x is not None else None for x in (words, pairs))).batches(batches)

    runs = texts.mapInArrow(run, RUN_LAYOUT).withColumn("bucket", _bucket())
    part = F.lit(0)
    if heads is not None:
        # At most PREFIX_BUCKETS rows, whatever the input, and as many parts again for buckets above their even share.
        sizes = [(r["bucket"], r["n"]) for r in heads.groupBy(_bucket().alias("bucket")).agg(F.sum("n").alias("n")).collect()]
        share = max(1, sum(n for _, n in sizes) // PREFIX_BUCKETS)
        deal = [1] * PREFIX_BUCKETS
        for bucket, n in sizes:
            deal[bucket] = -(-n // share)
        parts = F.element_at(F.from_json(F.lit(str(deal)), "array<long>"), F.col("bucket") + 1)
        part = F.pmod(F.xxhash64("phrase"), parts)
    # Runs of one prefix partition meet in one task; equal phrases are in one part of their bucket.
    placed = runs.withColumn("part", part).repartition("bucket", "part")
    return placed.groupBy("bucket", "part", "lang", "phrase").agg(F.sum("n").alias("n")).select("lang", "phrase", "n")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, words = (np.fromiter(map(xxhash.xxh3_64_intdigest, utf8(batch.column(i))), np.uint64, batch.num_rows) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array((_hashed(langs, words) & np.uint64(WORD_BITS - 1)).astype(np.int64))], ["slot"])


def word_bitmap(words: DataFrame) -> np.ndarray:
    """The (lang, phrase) rows as a bitmap over their hashes."""
    slots = words.select("lang", "phrase").mapInArrow(_slots, "slot long")
    block = F.expr(f"slot div {_WORD_BLOCK}").alias("block")
    return _bitmap(slots.groupBy(block).agg(F.bitmap_construct_agg(F.col("slot") % _WORD_BLOCK).alias("bits")).collect(), WORD_BITS)


def pair_bitmap(texts: DataFrame, words, least: int) -> np.ndarray:
    """The cells with at least ``least`` pairs of words in the bitmap ``words``."""
    cells = texts.mapInArrow(_cells(words)(least), "block long, places binary").repartition("block").sortWithinPartitions("block")
    return _bitmap(cells.mapInArrow(_frequent_cells(least), "block long, bits binary").collect(), PAIR_BITS)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases of 1 to ``longest`` words that come at least ``least`` times, and (lang, total) with the number of
    all words of each language."""
    spark, texts = docs.sparkSession, chunks(docs)
    # Of rarer words only their number in the language is needed: they come as rows without a phrase.
    words = counts(texts, (1,))
    kept = F.when(F.col("n") >= least, F.col("phrase"))
    words = written(words.groupBy("lang", kept.alias("phrase")).agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where("phrase is not null")
    if longest > 1:
        sieve = spark.sparkContext.broadcast(word_bitmap(frequent))
        pairs = spark.sparkContext.broadcast(pair_bitmap(texts, sieve, least))
        phrases = counts(texts, tuple(range(2, longest + 1)), sieve, pairs, frequent).where(F.col("n") >= least)
        frequent = written(frequent.unionByName(phrases), "frequent")
    discard(texts)
    return frequent.select("lang", F.size(F.split("phrase", " ", -1)).alias("words"), "phrase", "n"), totals


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, k, total, score of every phrase of two words or more, by the cut with the lowest score (the first of equal ones).

    Products are exact decimals of up to 38 digits; 1000 * a * n has 31 at most for counts below 10^14.
    """
    split = F.split("phrase", " ", -1)
    cuts = frequent.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "words", "a", "k",
        _part(F.col("w"), F.lit(1), F.col("k")).alias("left"),
        _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    known = frequent.select("lang", "phrase", "n")
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    # A language may hold most rows: its total is sent to them if the languages are few, which is counted first.
    joined = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(broadcast_if_small(totals), "lang")
    score = F.expr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(total as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    )
    best = F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("best")
    return joined.groupBy("lang", "phrase", "words", "a", "total").agg(best).select("lang", "phrase", "words", "a", "total", "best.*")


def not_contained(candidates: DataFrame, share: int = 100) -> DataFrame:
    """Candidates but those that lie inside a longer one which comes at least ``share`` per cent as often."""
    w = F.split("phrase", " ", -1)
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    places = F.flatten(F.transform(sizes, lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.struct(at.alias("at"), size.alias("size")))))
    inner = candidates.where("words > 2").select("lang", "a", w.alias("w"), F.explode(places).alias("p"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("p.at"), F.col("p.size")), " ").alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest_a"))
    joined = candidates.join(longer, ["lang", "phrase"], "left")
    return joined.where(F.col("longest_a").isNull() | (100 * F.col("longest_a") < share * F.col("a"))).drop("longest_a")


def top(found: DataFrame, n: int = TOP, groups: int = 64) -> DataFrame:
    """The first ``n`` of each language by score, then count, then phrase. Ranked in ``groups`` groups of phrases before the language as a whole, so
    the task of a language reads at most ``groups * n`` rows."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = Window.partitionBy("lang", "group").orderBy(*order)
    narrowed = found.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)
    return narrowed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= n).drop("group")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, n: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the collocations of each language.

    Reads lang and text only. Words are runs of anything but space and tab inside pieces that end at ``.,;:!?`` and line ends, A-Z lower-cased. A null
    text is empty, a null lang is ``und``; repeated rows count each time. Equal scores are ordered by count, then phrase, so results don't depend on
    the order of rows. A language without a candidate has no row; an empty table gives none. Very long texts are held one at a time.
    """
    frequent, totals = frequent_phrases(docs, longest, least)
    ranked = top(not_contained(written(scored(frequent, totals), "candidates")), n)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
