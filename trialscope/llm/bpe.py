"""Byte-pair encoding with a lexicon of frequent words, and decoding.

The most frequent words of the corpus and their ids are compiled into a minimal acyclic transducer:
states with equal futures are one state, so suffixes are shared, and each arc carries a number. The sum
of the numbers on a word's path is its place in the table of ids. The automaton is a few flat arrays in one
file, which workers map into memory. Words that it lacks are merged pair by pair, by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored, worker_store

#: Words of the lexicon, at most: a bounded table that every worker maps.
LEXICON_WORDS = 1 << 17
#: Chunks that a worker remembers per generation; places of the note of what it has met; distinct
#: chunks it counts before it passes them on.
REMEMBERED = 130_000
MET = 1 << 22
COUNTED = 300_000

#: What str.split() takes for white space and the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
WIDE = re.compile("[^\x00-\xff]")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Lexicon:
    """A minimal acyclic transducer from byte strings to id sequences, over a memory map or any buffer."""

    HEAD = "<5Q"

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> bytes:
        """Compile ``words``; states are shared as soon as a sorted word leaves them for good."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        counts: list[int] = []

        def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(final + sum(counts[t] for _, t in arcs))
            return register[key]

        ordered = sorted(words)
        path: list[list] = [[False, []]]  # of the last word: [final, settled arcs], one per prefix
        last = b""
        for word in ordered:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            for depth in range(len(last), shared, -1):
                final, arcs = path.pop()
                path[-1][1].append((last[depth - 1], settle(final, arcs)))
            path += [[False, []] for _ in range(len(word) - shared)]
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[depth - 1], settle(final, arcs)))
        start = settle(*path[0])

        first, labels, targets, numbers = [0], bytearray(), [], []
        for final, arcs in states:
            before = int(final)
            for label, target in arcs:
                labels.append(label)
                targets.append(target)
                numbers.append(before)
                before += counts[target]
            first.append(len(labels))
        finals = bytes(final for final, _ in states)
        ends = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered])]) if ordered else np.zeros(1)
        ids = np.array([i for w in ordered for i in words[w]], dtype="<u4")
        parts = [
            np.array(first, dtype="<u4").tobytes(), np.array(targets, dtype="<u4").tobytes(), np.array(numbers, dtype="<u4").tobytes(),
            ends.astype("<u4").tobytes(), ids.tobytes(), bytes(labels), finals,
        ]
        return struct.pack(Lexicon.HEAD, len(states), len(labels), len(ordered), len(ids), start) + b"".join(parts)

    def __init__(self, buffer) -> None:
        at = struct.calcsize(self.HEAD)
        states, arcs, words, ids, self.start = struct.unpack(self.HEAD, buffer[:at])
        view = memoryview(buffer)
        sections = []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            sections.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.numbers, self.ends, _ = sections
        self.ids_at = at - 4 * ids
        self.labels_at, self.finals_at, self.buffer = at, at + arcs, buffer
        self.size = words

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Over a memory map of an unnamed file of this worker, which ends with it."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian unsigned 32-bit integers, or None."""
        state, number, base, buffer = self.start, 0, self.labels_at, self.buffer
        first = self.first
        for i in range(len(word)):
            arc = buffer.find(word[i : i + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            number += self.numbers[arc - base]
            state = self.targets[arc - base]
        if not buffer[self.finals_at + state]:
            return None
        return buffer[self.ids_at + 4 * self.ends[number] : self.ids_at + 4 * self.ends[number + 1]]


class Merges:
    """The merge rules of a byte-level vocabulary with word ends."""

    def __init__(self, source: dict) -> None:
        model = source["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.last = [vocabulary[c + suffix] for c in letters]
        #: (left, right) -> rank and merged id in one number, so that the least number is the first merge.
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[vocabulary[a], vocabulary[b]] = rank << 32 | vocabulary[a + b]

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank is merged first, the leftmost of equal ones."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._short(ids) if len(ids) <= 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, never = self.pairs.get, 1 << 62
        order = [get(p, never) for p in zip(ids, ids[1:])]
        while order:
            first = min(order)
            if first == never:
                break
            i, merged = order.index(first), first & 0xFFFFFFFF
            ids[i] = merged
            del ids[i + 1], order[i]
            if i:
                order[i - 1] = get((ids[i - 1], merged), never)
            if i < len(order):
                order[i] = get((merged, ids[i + 1]), never)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            first, i, a, b = heapq.heappop(heap)
            merged = first & 0xFFFFFFFF
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (ids[left], ids[right]) in pairs:
                    heapq.heappush(heap, (pairs[ids[left], ids[right]], left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]


class Encoder:
    """Texts to ids, chunk by chunk between white space; ``chunk_ids`` gives the ids of one chunk, as bytes.

    No rule of the vocabulary reaches over white space, so a text's ids are its chunks' ids in a row; and
    none reaches from letters to the full stop or comma after them. Chunks that are met a second time are
    remembered, in two generations: when the young one is full it becomes the old one, and what is met
    again moves back.
    """

    def __init__(self, chunk_ids: Callable[[str], bytes], remembered: int = REMEMBERED) -> None:
        self.chunk_ids, self.remembered = chunk_ids, remembered
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.met = bytearray(MET)
        self.marks = {mark: chunk_ids(mark) for mark in ".,"}

    def _new(self, chunk: str) -> bytes:
        """Ids of a chunk that is not in the young generation."""
        ids = self.old.get(chunk)
        if ids is None:
            word = chunk[:-1]
            if chunk[-1] in self.marks and word.isalpha():
                ids = (self.known.get(word) or self._new(word)) + self.marks[chunk[-1]]
            else:
                ids = self.chunk_ids(chunk)
            place = hash(chunk) % MET
            if not self.met[place]:
                self.met[place] = 1
                return ids
        if len(chunk) < 64:
            self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SEPARATORS.search(text):
            return self.chunk_ids(text)
        if len(self.known) > self.remembered:
            self.old, self.known, self.met = self.known, {}, bytearray(MET)
        # In these characters lower case is the same before and after the text is cut; special tokens are of raw text.
        chunks = (text if "<|" in text or WIDE.search(text) else text.lower()).split()
        out = list(map(self.known.get, chunks))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            out[at] = self.known.get(chunks[at]) or self._new(chunks[at])
        return b"".join(out)


class Words:
    """A tokenizer file's normaliser and word splitter: text to words as UTF-8 bytes, special tokens as their ids."""

    def __init__(self, source: str) -> None:
        data = json.loads(source)
        self.tokenizer = Tokenizer.from_str(source)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.model = data["model"]

    def __call__(self, text: str) -> list[bytes | int]:
        if text.isascii() and text.isalpha():
            return [text.lower().encode()]
        if PLAIN.fullmatch(text) and "<|" not in text:
            return [w.encode() for w in PIECES.findall(text.lower())]
        out: list[bytes | int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part)
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                    out.append(bytes(self.byte_of[c] for c in piece))
        return out


def _loaded(source: str, lexicon: bytes) -> dict:
    """Words, merges, lexicon and encoder of this worker, made once for all its tasks."""
    store = worker_store("large-bpe-" + hashlib.sha256(source.encode() + lexicon).hexdigest())
    if not store:
        words, table = Words(source), Lexicon.mapped(lexicon)
        merges, vocabulary = Merges({"model": words.model}), words.model["vocab"] | words.special
        words.model = None  # what is left of it is in the tables

        def word_ids(word: bytes | int) -> bytes:
            if isinstance(word, int):
                return struct.pack("<I", word)
            ids = table.get(word)
            return ids if ids is not None else array("I", merges.encode(word)).tobytes()

        def chunk_ids(chunk: str) -> bytes:
            return b"".join([word_ids(w) for w in words(chunk)])

        tokens: list[str] = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = token
        store |= {"encoder": Encoder(chunk_ids, 2 * REMEMBERED), "tokens": tokens}
    return store


def decode(ids: bytes, tokens: list[str]) -> str:
    """The tokens of ``ids`` joined by one blank, as a tokenizer without a decoder joins them; unknown ids are passed over."""
    try:
        return " ".join(map(tokens.__getitem__, memoryview(ids).cast("I")))
    except IndexError:
        return " ".join([tokens[i] for i in memoryview(ids).cast("I") if i < len(tokens)])


def _counted(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words(source)
        chunks: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words: Counter[bytes] = Counter()
            for chunk, n in chunks.items():
                for word in split(chunk):
                    if not isinstance(word, int):
                        words[word] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                if text:
                    chunks.update([text] if SEPARATORS.search(text) else text.split())
                if len(chunks) > COUNTED:
                    yield out()
        if chunks:
            yield out()

    return run


def frequent_words(documents: DataFrame, source: str, most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts, ``most`` at most, best first.

    Words are counted in tasks and summed. The counts of counts, in eighths of octaves, give the least
    count that ``most`` words at most have, so no task and not the driver sees more than these.
    """
    counted = documents.select("text").mapInArrow(_counted(source), "word binary, n long")
    counted = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("step", F.floor(8 * F.log2("n"))), "words")
    least, total = None, 0
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):  # at most 512 rows
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return []
    top = counted.where(F.col("step") >= least).select("word", "n").collect()
    return [bytes(r["word"]) for r in sorted(top, key=lambda r: (-r["n"], r["word"]))]


def compile_lexicon(words: list[bytes], source: str) -> bytes:
    merges = Merges(json.loads(source))
    return Lexicon.build({w: merges.encode(w) for w in words})


def _encoded(source, lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(source.value, lexicon.value)
        encoder, tokens = loaded["encoder"], loaded["tokens"]
        for batch in batches:
            place = batch.schema.get_field_index("text")
            others = [i for i in range(batch.num_columns) if i != place]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, decoded = [], []
                for text in part.column(place):
                    one = encoder.encode(text.as_py() or "")
                    ids.append(one)
                    decoded.append(decode(one, tokens))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in others), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    [*(part.schema.names[i] for i in others), "ids", "decoded"],
                )

    return run


def encode_texts(documents: DataFrame, tokenizer_file: str, keep: list[str], words: int = LEXICON_WORDS) -> DataFrame:
    """Columns ``keep`` with ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` for every whole ``text``.

    Ids equal those of the tokenizers library with add_special_tokens=False, special tokens in the text
    included; ``decoded`` equals its decode(ids, skip_special_tokens=False). Null texts count as empty and
    give no ids. The file must hold a byte-level BPE model with word ends, whose splitter never joins
    over white space, and no decoder. Columns of ``keep`` named text, ids or decoded are left out.

    Two passes: all texts are counted for the lexicon of the ``words`` most frequent words, which is
    broadcast (its size is bounded by ``words``) and memory-mapped by each worker; then they are encoded.
    """
    keep = [c for c in keep if c not in ("text", "ids", "decoded")]
    with open(tokenizer_file, encoding="utf-8") as file:
        source = file.read()
    rows = documents.select(*keep, "text")
    context = documents.sparkSession.sparkContext
    lexicon = context.broadcast(compile_lexicon(frequent_words(rows, source, words), source))
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_encoded(context.broadcast(source), lexicon), f"{kept}, ids binary, decoded string")
