"""Packing documents into sequences of bounded length: shortest pack first over the histogram of piece lengths.

Documents are tokenised once and cut into pieces of at most 2048 tokens. Only the histogram of piece lengths, which has
at most 2048 rows whatever the input, reaches the driver. There lengths are placed longest first, each time into the
packs that are shortest so far, and equal packs are handled together as one pattern with a count. Each step moves whole
patterns or splits one, so there are at most a few thousand patterns at any input size. A piece finds its place by its
rank among the pieces of its length; ranks come from counts of (task, length), never from a sort of all pieces.
"""

from __future__ import annotations

import codecs
import os
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, filterfalse, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hookflow.llm.common import pieces, utf8, written

SEQUENCE_TOKENS = 2048
END_OF_DOCUMENT = 1  # appended to each document
_END = np.array([END_OF_DOCUMENT], "<u4")
# Words that a task keeps, and words that it looks up at once; about 160 bytes a word of common length, so at most about 170 MB a task, forms included.
_WORDS_KNOWN, _WORDS_AT_ONCE = 1 << 19, 1 << 18
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")  # what ``bytes.split()`` splits at
# The UTF-8 bytes of ASCII without control characters, and of the letters ß-ÿ, whose second bytes, C3 being the only lead byte, are all that the rest
# can be. The normaliser does no more to words of these than to lower A-Z, and the split patterns do with them what _PARTS does.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(32, 127), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
# Those of them that letters are made of, and the blank after a word.
_LETTERS = _PLAIN.copy()
_LETTERS[[*range(33, 65), *range(91, 97), *range(123, 127)]] = False
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
# The character that stands for each byte in the model's tokens; a blank stays one.
_SPARE = iter(range(256, 512))
_SHOWN = "".join(chr(b if b in range(33, 127) or b in range(161, 256) and b != 173 else next(_SPARE)) for b in range(256)).replace("\u0120", " ")
PIECE_LAYOUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, local_rank long"


def _data(values: pa.BinaryArray) -> bytes:
    """The bytes of all values, one after another."""
    _, offsets, data = values.buffers()
    first, last = np.frombuffer(offsets, np.int32)[[values.offset, values.offset + len(values)]].tolist()
    return data.to_pybytes()[first:last] if last > first else b""


class _Flat:
    """Runs of ids by number, in one flat array."""

    def __init__(self):
        self.ids, self.starts, self.lengths = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def extend(self, ids: np.ndarray, lengths: np.ndarray, order: np.ndarray | None = None) -> None:
        """Adds runs, given in that order of their numbers or, without it, by number."""
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        if order is not None:
            back = np.argsort(order)
            starts, lengths = starts[back], lengths[back]
        self.starts = np.concatenate((self.starts, starts))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids))

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these runs, one after another."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class _WordIds(dict):
    """Token ids of texts by way of their words: each word has a number, and the numbers' ids lie in one flat array. The tokenizer
    drops white space, and neither its normaliser nor its split patterns look past it, so a text's ids are its words' ids in a row.

    Of one task, which drops it at its end. Words are numbered in runs of ``_WORDS_AT_ONCE``, whatever text they are from; the forms that were
    tokenised for them are words of the table too. Before a run a table of more than ``_WORDS_KNOWN`` words keeps the more used half at most, so
    it never holds more than these and, for each word of a run, the word and its form.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        # The ids of marks that end a word after a letter; such a mark is always a token of its own.
        self.tails = {mark.encode(): self.tokenizer.encode(mark, add_special_tokens=False).ids for mark in string.punctuation if mark != "'"}
        self.tail_of = np.full(256, -1, np.int64)
        for mark, ids in self.tails.items():
            self.tail_of[mark[0]] = ids[0]
        # Ids that end a word: letters and nothing else make one such id.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[number] = token.endswith("</w>")
        # The same model without the steps that plain words need not take; they come as the characters that stand for their bytes.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        self.words, self.uses = _Flat(), np.empty(0, np.int64)

    def _form(self, word: bytes) -> tuple[bytes, bytes]:
        """What of a word is tokenised, and the mark after it. Case does not count in ASCII, special tokens aside."""
        if b"<|" in word:
            return word, b""
        mark = word[-1:]
        if not word.isascii():
            return (word[:-1], mark) if mark in self.tails and word.decode()[-2:-1].isalpha() else (word, b"")
        word = word.lower()
        return (word[:-1], mark) if mark in self.tails and word[-2:-1].isalpha() else (word, b"")

    def _forms(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """``_form`` of many words: what is tokenised of each, and the ids of the marks, -1 for none. ASCII words are taken all at once."""
        joined = b" ".join(words) + b" "
        flat = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(flat == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        odd = np.maximum.reduceat(flat, starts) >= 128
        if b"<|" in joined:
            odd |= np.fromiter((b"<|" in word for word in words), bool, len(words))
        lower = np.frombuffer(joined.lower(), np.uint8).copy()
        last = lower[ends - 1]
        # Before the only byte of a word stands the blank of the word before it, or at the start what ends all, a blank too.
        before = lower[ends - 2]
        tails = np.where((before >= 97) & (before <= 122) & ~odd, self.tail_of[last], -1)
        lower[ends[tails >= 0] - 1] = 32
        forms = lower.tobytes().split()
        marked = self.tail_of[last] >= 0
        for i in np.flatnonzero(odd & ~marked).tolist():
            forms[i] = words[i]
        for i in np.flatnonzero(odd & marked).tolist():
            forms[i], mark = self._form(words[i])
            tails[i] = self.tails[mark][0] if mark else -1
        return forms, tails

    def _encoded(self, joined: bytes, count: int, plain: bool, letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of so many forms with a blank between them, all of letters or none, and the number of each form's ids. Plain ones are those that
        ``_PARTS`` splits."""
        if plain and letters:
            found = self._ended(self.model, codecs.charmap_decode(joined.lower(), "strict", _SHOWN)[0], count)
        elif plain:
            parts = list(map(_PARTS.findall, joined.lower().split()))
            counts = np.fromiter(map(len, parts), np.int64, count)
            found = self._ended(self.model, codecs.charmap_decode(b" ".join(chain.from_iterable(parts)), "strict", _SHOWN)[0], int(counts.sum()))
            found = found and (found[0], np.add.reduceat(found[1], np.cumsum(counts) - counts))
        else:
            found = self._ended(self.tokenizer, joined.decode(), count) if letters else None
        if found:
            return found
        # Given as words already, they are tokenised one by one, in one call.
        given = self.tokenizer.encode(joined.decode().split(" "), is_pretokenized=True, add_special_tokens=False)
        return np.array(given.ids, "<u4"), np.bincount(np.array(given.word_ids, np.int64), minlength=count)

    def _ended(self, tokenizer, text: str, count: int) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_encoded`` for so many words in one text, which is faster than word by word, unless one of them has more ends than one:
        each has one at least, so equal numbers show that each has one."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == count and ends[-1] == len(ids) - 1 else None

    def _number(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray, order: np.ndarray | None = None) -> None:
        self.update(zip(words, range(len(self), len(self) + len(words))))
        self.words.extend(ids, lengths, order)

    def _learn(self, words: list[bytes]) -> None:
        """Takes new words into the table, with the forms that it lacks; only these are tokenised."""
        names, tails = self._forms(words)
        changed = np.fromiter(map(bytes.__ne__, names, words), bool, len(words))
        wanted = list(compress(names, changed))
        unseen = dict.fromkeys(compress(words, ~changed))
        unseen.update(dict.fromkeys(filterfalse(self.__contains__, wanted)))
        self._tokenise(list(unseen))
        # A word that another one's form is may be in the table by now.
        forms = np.fromiter(map(self.__getitem__, wanted), np.int64, len(wanted))
        tails, lengths = tails[changed], self.words.lengths[forms]
        ids = np.insert(self.words.take(forms), np.cumsum(lengths)[tails >= 0], tails[tails >= 0].astype("<u4"))
        self._number(list(compress(words, changed)), ids, lengths + (tails >= 0))

    def _tokenise(self, forms: list[bytes]) -> None:
        if not forms:
            return
        flat = np.frombuffer(b" ".join(forms) + b" ", np.uint8)
        ends = np.flatnonzero(flat == 32) + 1
        sizes = np.diff(ends, prepend=0)
        plain = np.logical_and.reduceat(_PLAIN[flat], ends - sizes)
        marked = np.flatnonzero((flat[:-1] == ord("<")) & (flat[1:] == ord("|")))
        plain[np.searchsorted(ends, marked, side="right")] = False
        letters = np.logical_and.reduceat(_LETTERS[flat], ends - sizes)
        odd = list(compress(forms, ~plain))
        letters[~plain] = np.fromiter((form.decode().isalpha() for form in odd), bool, len(odd))
        found, order = [], []
        for easy in (True, False):
            for whole in (True, False):
                kind = (plain == easy) & (letters == whole)
                order.append(np.flatnonzero(kind))
                joined, cuts = flat[np.repeat(kind, sizes)].tobytes(), np.cumsum(sizes[kind]).tolist()
                for i in range(0, len(cuts), 4096):
                    last = min(i + 4096, len(cuts))
                    found.append(self._encoded(joined[cuts[i - 1] if i else 0 : cuts[last - 1] - 1], last - i, easy, whole))
        ids, lengths = (np.concatenate(part) for part in zip(*found, strict=True))
        self._number(forms, ids, lengths, np.concatenate(order))

    def texts(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text with the end token; a bounded number of words is looked up at once, however long a text is or the texts together."""
        # The texts in a row, a blank after each; words end where a blank follows another byte, and further blanks are left out.
        data = np.frombuffer(b" ".join([*(text or b"" for text in texts), b""]).translate(_BLANKS), np.uint8)
        blank = data == 32
        closes = blank.copy()
        closes[1:] &= ~blank[:-1]
        closes[:1] = False
        ends = np.flatnonzero(closes) + 1
        words = np.searchsorted(ends, np.cumsum([len(text or b"") + 1 for text in texts]), side="right")
        if len(ends) < np.count_nonzero(blank):
            data = data[closes | ~blank]
            ends = np.flatnonzero(data == 32) + 1
        ids, lengths = [np.empty(0, "<u4")], [np.zeros(1, np.int64)]
        for first in range(0, len(ends), _WORDS_AT_ONCE):
            start, run = ends[first - 1] if first else 0, ends[first : first + _WORDS_AT_ONCE]
            numbers = self._numbers(data[start : run[-1]], run - start)
            ids.append(self.words.take(numbers))
            lengths.append(self.words.lengths[numbers])
        found, start = np.concatenate(ids), 0
        for end in np.cumsum(np.concatenate(lengths))[words].tolist():
            yield np.concatenate((found[start:end], _END))
            start = end

    def _numbers(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of words that lie in a row, each with a blank after it; equal words are looked up once."""
        self._make_room()
        offsets = np.concatenate((np.zeros(1, np.int32), ends.astype(np.int32)))
        found = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = _data(found.dictionary).split()
        numbers = np.fromiter(map(self.get, distinct, repeat(-1)), np.int64, len(distinct))
        if (new := numbers < 0).any():
            words = list(compress(distinct, new))
            self._learn(words)
            numbers[new] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        numbers = numbers[found.indices.to_numpy()]
        used = np.bincount(numbers, minlength=len(self))
        used[: len(self.uses)] += self.uses
        self.uses = used
        return numbers

    def _make_room(self) -> None:
        """Most words of a full table were met once; those met more often stay, the most used ones if they are many."""
        if len(self) <= _WORDS_KNOWN:
            return
        often = np.argsort(-self.uses, kind="stable")[: _WORDS_KNOWN // 2]
        kept = np.sort(often[self.uses[often] > 1])
        names, ids = list(self), self.words.take(kept)
        lengths = self.words.lengths[kept]
        self.clear()
        self.update(zip((names[i] for i in kept.tolist()), range(len(kept)), strict=True))
        self.words, self.uses = _Flat(), self.uses[kept]
        self.words.extend(ids, lengths)


def _pieces(tokenizer_path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, ranks = _WordIds(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in pieces(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.texts(utf8(batch.column(1))), strict=True):
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), task, ranks[len(piece)]))
                    ranks[len(piece)] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECE_LAYOUT.split(", ")])

    return run


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE_TOKENS) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(number of packs, ((piece length, pieces of it), ...)) patterns that place each length of the histogram as often as it occurs."""
    packs: dict[int, list[list]] = defaultdict(list)  # tokens so far -> [count, contents]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            used = min((u for u in packs if u + length <= size), default=None)
            if used is None:
                # Equal pieces open packs of their own; later, shorter pieces join them.
                packs[length].append([left, ((length, 1),)])
                break
            pattern = packs[used].pop()
            if not packs[used]:
                del packs[used]
            moved = min(left, pattern[0])
            if pattern[0] > moved:
                packs[used].append([pattern[0] - moved, pattern[1]])
            contents = pattern[1]
            if contents[-1][0] == length:
                contents = (*contents[:-1], (length, contents[-1][1] + 1))
            else:
                contents = (*contents, (length, 1))
            packs[used + length].append([moved, contents])
            left -= moved
    return [(count, contents) for used in sorted(packs, reverse=True) for count, contents in packs[used]]


def slots(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) of the patterns' places, by rank: the place takes as many ranks as
    its pattern has packs, one for each sequence from the first on."""
    found: dict[int, list] = defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, contents in patterns:
        offset = 0
        for length, times in contents:
            for _ in range(times):
                found[length].append((next_rank[length], sequence, offset))
                next_rank[length] += count
                offset += length
        sequence += count
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                rows = places[int(length[at[0]])]
                hit = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                sequence[at], offset[at] = hit[:, 1] + rank[at] - hit[:, 0], hit[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Reads doc_id and text only. A null or empty text is one piece that holds the end token. Repeated rows are packed as often as
    they come; a null doc_id is kept. An empty table gives no rows. ``tokenizer_path`` must be readable on every worker.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cut = written(source.mapInArrow(_pieces(tokenizer_path, size), PIECE_LAYOUT), "pieces")
    # A task id names one task of the job that wrote the pieces, so ranks are fixed once they are written.
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))
    ranked = cut.join(bases, ["task", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local_rank")).alias("rank")
    )
    layout = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(places), layout)
