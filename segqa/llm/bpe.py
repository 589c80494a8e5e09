"""BPE encoding and decoding with a pair occurrence index.

A task walks through its texts in blocks. The words of a block that it has not met yet are
merged together: an index maps each adjacent pair, by its rank, to all its positions in the
block; active ranks are applied in ascending order, at all their positions at once; and
each merge updates the lists of the pairs it touches. Texts are then put together from the
merged words.

The result equals that of the ``tokenizers`` library for vocabulary files of the kind
"BPE with word ends, NFC, white space dropped, lower case"; other files are refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase
from tokenizers.normalizers import Sequence as NormalizerSequence
from tokenizers.pre_tokenizers import Split

from segqa.llm.arrow import with_fields

# Characters of text whose new words share one pair index.
BLOCK_CHARS = 8_000_000
# Runs that a worker remembers the ids of; beyond that it forgets them all and starts anew.
REMEMBERED = 600_000
# Ranks that share a list of the pair index; within a list the lowest rank of a word goes first.
LIST_RANKS = 256

# Fixed values, as the vocabulary file and Unicode define them.
WORD_END = "</w>"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
# Separators for str.split() that Unicode does not count as white space.
NOT_WHITE = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a vocabulary file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        split = [s["pattern"].get("Regex") for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or split != [WORDS] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a lower-case BPE vocabulary with word ends")
        ids: dict[str, int] = model["vocab"]
        left = np.array([ids[a] for a, _ in model["merges"]], np.int64)
        right = np.array([ids[b] for _, b in model["merges"]], np.int64)
        made = np.array([ids[a + b] for a, b in model["merges"]], np.int64)
        born = np.full(max(ids.values()) + 1, -1)
        born[made] = np.arange(len(made))
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before the merges it builds on")
        # Symbols that a merge makes, by rank; ranks by pair in an open hash table.
        self.made = made.astype(np.int32)
        self.bits = max(4, len(made).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        waiting = np.arange(len(made))
        keys = left << 32 | right
        slot = self._slot(keys)
        while len(waiting):
            free = self.keys[slot] < 0
            # Of those that want the same slot, the last one written gets it.
            self.keys[slot[free]] = keys[waiting[free]]
            self.ranks[slot[free]] = waiting[free]
            lost = self.ranks[slot] != waiting
            waiting, slot = waiting[lost], (slot[lost] + 1) & (1 << self.bits) - 1
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.final = np.array([ids[c + WORD_END] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        self.library: tuple | None = None
        self.words = regex.compile(WORDS)
        self.words_in_lines = regex.compile(rf"\n|{WORDS}")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ keys >> 29).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where no merge is."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        ranks = np.where(found == keys, self.ranks[slot], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (1 << self.bits) - 1
            found = self.keys[slot[open_]]
            same = found == keys[open_]
            ranks[open_[same]] = self.ranks[slot[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return ranks

    def split(self, run: str) -> list[str | int]:
        """Words of a run without white space; a special token as its id."""
        found: list[str | int] = []
        for part in self.special_pattern.split(run):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += self._newer(part) if _unassigned(part) else self.words.findall(lower(part))
        return found

    def _newer(self, text: str) -> list[str]:
        """Words of a text with characters that Unicode's tables here do not have yet, by the library's own tables."""
        if self.library is None:
            self.library = (NormalizerSequence([NFC(), Lowercase()]), Split(Regex(WORDS), "removed", invert=True))
        normalizer, splitter = self.library
        return [w for w, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]

    def split_lines(self, runs: list[str]) -> list[list[str | int]]:
        """``split`` of many runs in one go."""
        odd = ["<" in r or _unassigned(r) for r in runs]
        words: list[str | int] = []
        found: list[list[str | int]] = []
        for word in self.words_in_lines.findall(lower("".join(f"{r}\n" for r, o in zip(runs, odd, strict=True) if not o))):
            if word == "\n":
                found.append(words)
                words = []
            else:
                words.append(word)
        ready = iter(found)
        return [self.split(r) if o else next(ready) for r, o in zip(runs, odd, strict=True)]


def _unassigned(text: str) -> bool:
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text)


def lower(text: str) -> str:
    """NFC and lower case letter by letter, so without the final sigma rule of str.lower()."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def merge_words(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of non-empty words, one after the other, and the end of each word among them."""
    coded = [w.encode("utf-8") for w in words]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    letters = np.frombuffer(b"".join(coded), np.uint8)
    n = len(letters)
    ends = np.cumsum(lengths)
    symbol = vocabulary.inner[letters]
    symbol[ends - 1] = vocabulary.final[letters[ends - 1]]
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    # -1 beyond the ends of a word.
    following = np.arange(1, n + 1, dtype=np.int32)
    following[ends - 1] = -1
    previous = np.arange(-1, n - 1, dtype=np.int32)
    previous[ends - lengths] = -1
    # Rank of the pair that starts at a place, or -1.
    active = np.full(n, -1, np.int32)
    inside = np.flatnonzero(following >= 0)
    active[inside] = vocabulary.rank(symbol[inside], symbol[inside + 1])

    lists: list[list[np.ndarray]] = [[] for _ in range(len(vocabulary.made) // LIST_RANKS + 1)]

    def file(places: np.ndarray) -> None:
        """Put places into the lists of their active ranks."""
        which = active[places] // LIST_RANKS
        order = np.argsort(which, kind="stable")
        places, which = places[order], which[order]
        cuts = np.flatnonzero(np.diff(which)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(places)], strict=True):
            lists[which[start]].append(places[start:end])

    def note(places: np.ndarray) -> None:
        """The pairs that start at these places have changed."""
        places = places[following[places] >= 0]
        active[places] = vocabulary.rank(symbol[places], symbol[following[places]])
        places = places[active[places] >= 0]
        if len(places):
            file(places)

    noted = np.flatnonzero(active >= 0)
    if len(noted):
        file(noted)
    for number, waiting in enumerate(lists):
        while waiting:
            places = _distinct(np.concatenate(waiting))
            waiting.clear()
            # An entry is stale if its pair has gone or has another rank by now.
            places = places[active[places] // LIST_RANKS == number]
            if not len(places):
                continue
            # The lowest rank of each word, at all its places.
            lowest = np.minimum.reduceat(active[places], firsts := _firsts(word[places]))
            ready = active[places] == np.repeat(lowest, np.diff([*firsts, len(places)]))
            left = places[ready]
            if len(left) < len(places):
                waiting.append(places[~ready])
            # Where equal pairs overlap, as in a a a, every other one counts from the left.
            linked = np.zeros(len(left), bool)
            linked[1:] = following[left[:-1]] == left[1:]
            if linked.any():
                at = np.arange(len(left))
                left = left[(at - np.maximum.accumulate(np.where(linked, 0, at))) % 2 == 0]
            right = following[left]
            after = following[right]
            symbol[left] = vocabulary.made[active[left]]
            symbol[right] = -1
            following[left] = after
            following[right] = -1
            active[right] = active[left] = -1
            previous[after[after >= 0]] = left[after >= 0]
            before = previous[left]
            note(_distinct(np.concatenate([left, before[before >= 0]])))
    alive = symbol >= 0
    return symbol[alive].astype(np.uint32), np.cumsum(np.bincount(word[alive], minlength=len(words)))


def _distinct(places: np.ndarray) -> np.ndarray:
    """In ascending order; sorting beats the hashing of np.unique here."""
    places = np.sort(places)
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


def _firsts(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1])


class Encoder:
    """Encodes and decodes texts; remembers the pieces it has merged."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.white = re.compile(f"[{WHITE_SPACE}]+")
        self.ids: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in NOT_WHITE):
            return [c for c in self.white.split(text) if c]
        return text.split()

    def learn(self, runs: set[str]) -> None:
        """Merge the runs that are not known yet, all with one pair index."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        new = [r for r in runs if r not in self.ids]
        if not new:
            return
        split = self.vocabulary.split_lines(new)
        words = list({w for run in split for w in run if type(w) is str})
        known: dict[str | int, bytes] = {i: array("I", [i]).tobytes() for i in self.vocabulary.special.values()}
        if words:
            ids, ends = merge_words(words, self.vocabulary)
            data = ids.tobytes()
            stops = (4 * ends).tolist()
            known.update(zip(words, (data[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
        get = known.__getitem__
        self.ids.update(zip(new, [get(s[0]) if len(s) == 1 else b"".join(map(get, s)) for s in split], strict=True))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers; null is the empty text."""
        block: list[list[str]] = []
        size = 0
        for text in texts:
            block.append(self.chunks(text or ""))
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield from self._finish(block)
                block, size = [], 0
        yield from self._finish(block)

    def _finish(self, block: list[list[str]]) -> Iterator[bytes]:
        self.learn(set().union(*block))
        known = self.ids.__getitem__
        for chunks in block:
            yield b"".join(map(known, chunks))

    def decode(self, ids: bytes) -> str:
        """Tokens of the ids, special ones included, with a blank between."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, array("I", ids)))


@lru_cache(maxsize=1)
def _encoder(source: str) -> Encoder:
    return Encoder(Vocabulary(source))


def vocabulary_source(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file (a few MB), read once by the driver and sent to the executors."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(source: Broadcast) -> Encoder:
    """The encoder of a worker: the runs that one task has merged, at most ``REMEMBERED`` and a block, need not be merged in the next."""
    return _encoder(source.value)


def encode(df: DataFrame, text_col: str, path: str, ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Add the token ids of each text as an array, and optionally the decoded text.

    Every row and column stays. A null text is the empty text and has no ids. Columns of
    ``df`` that are named like the new ones are replaced.
    """
    source = vocabulary_source(df.sparkSession, path)
    kept = [c for c in df.columns if c not in (ids_col, decoded_col)]
    base = df.select(*kept)
    schema = with_fields(base.schema, f"`{ids_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(source)
        for batch in batches:
            texts = batch.column(kept.index(text_col)).to_pylist()
            # A few rows at a time, so that ids and decoded texts of a batch need not fit at once.
            for at in range(0, len(texts), 256):
                part = [*coder.encode(texts[at : at + 256])]
                columns = batch.slice(at, len(part)).columns + [pa.array([array("i", x) for x in part], pa.list_(pa.int32()))]
                if decoded_col:
                    columns.append(pa.array(map(coder.decode, part), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(run, schema)
