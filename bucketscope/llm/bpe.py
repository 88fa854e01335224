"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

A first pass counts the normalised words of all documents in Spark; the most frequent ones
are compiled with their ids into an automaton that shares prefixes and suffixes
(``Lexicon.compile``), one file that every Python worker memory-maps. The second pass looks
each word up by walking the automaton, whose arc outputs add up to the word's row in the id
table; a word that is not in it is merged exactly, pair by pair, for many words at once.

Texts are normalised and split with Python's Unicode tables. Raw words with a letter that the
vocabulary's own rules take otherwise (newer Unicode; found once, over all code points) go
through those rules instead.

Nulls and empty texts give no ids. Very long texts are encoded whole. Equal texts give equal
ids; repeated rows give repeated results. Extra columns pass through ``encode``; a column
already named as an output is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import pickle
import shutil
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bucketscope.llm.columnar import gathered
from bucketscope.llm.tables import removed, stored, table, worked_out

#: Most words compiled into the lexicon: the most frequent of the whole corpus.
LEXICON_WORDS = 65_536
#: Distinct raw words remembered by a task before it starts afresh.
MEMORY_WORDS = 200_000
_SLICE_CHARS = 1 << 20
_CODE_BLOCK = 1 << 12
_NONE = np.iinfo(np.int64).max

# Fixed values of the vocabulary's format: how words are found in normalised text, and white space.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _BLANK + r"\p{L}\p{N}]+")
_LINED = regex.compile(_WORD.pattern + r"|\n")
_SPACE = regex.compile(f"[{_BLANK}]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
def normalised(text: str) -> str:
    """NFC and lower case, letter by letter (no final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    low = text.lower()
    return "".join(c.lower() for c in text) if "ς" in low else low


def words_of(raw: list[str]) -> list[str]:
    """The words of each raw word, each followed by "\\n"."""
    return _LINED.findall(normalised("\n".join(raw)) + "\n") if raw else []


def split_raw(text: str) -> list[str]:
    """What white space separates."""
    return [x for x in _SPACE.split(text) if x] if _ODD_SPACE.search(text) else text.split()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTE_OF = {c: b for b, c in enumerate(byte_letters())}


def odd_table(splitter: str) -> np.ndarray:
    """For each code point 1 if Python's Unicode tables take it otherwise than the vocabulary's do: class, lower case or composition; those that Python does not know yet are all among them."""
    rules = Tokenizer.from_str(splitter)
    space = regex.compile(f"[{_BLANK}]")
    differs = lambda text: rules.normalizer.normalize_str(text) != normalised(text)
    is_odd = np.zeros(0x110000, np.int8)
    for first in range(0, len(is_odd), _CODE_BLOCK):  # in blocks, so that the driver holds little at a time
        kinds = {c: unicodedata.category(chr(c)) for c in range(first, first + _CODE_BLOCK)}
        odd = {c for c, k in kinds.items() if k == "Cn"}
        known = [c for c, k in kinds.items() if k not in ("Cn", "Co", "Cs")]  # private ones are alike everywhere
        odd |= {c for c in known if not space.match(chr(c)) and differs(chr(c))}
        odd |= {c for c in known if unicodedata.combining(chr(c)) and any(differs(x) for m in "\u0334\u0315" for x in (f"a{chr(c)}{m}", f"a{m}{chr(c)}"))}  # the order of marks
        for before in "a!":  # what a letter or a mark forms one word with
            text = "".join(f"{before}{chr(c)} " for c in known)
            theirs, mine = {span for _, span in rules.pre_tokenizer.pre_tokenize_str(text)}, {m.span() for m in _WORD.finditer(text)}
            odd |= {known[a // 3] for a, _ in theirs ^ mine}
        is_odd[list(odd)] = 1
    return is_odd


def odd_letters(is_odd: np.ndarray) -> str:
    """A pattern of them. It is slow over long texts: ``odd_words`` looks letters up instead."""
    edges = np.flatnonzero(np.diff(is_odd, prepend=0, append=0)).tolist()
    return "[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True)) + "]"


def odd_words(raw: list[str], is_odd: np.ndarray) -> list[str]:
    """The raw words with an odd letter; each letter is looked up once, ASCII ones only if any of them is odd."""
    if not is_odd[:128].any():
        raw = [w for w in raw if not w.isascii()]
    points = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
    hits = np.flatnonzero(is_odd[points])
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    return [raw[i] for i in np.unique(np.searchsorted(ends, hits, "right")).tolist()]


class Vocabulary:
    """Token strings, merge ranks and special tokens, as flat arrays."""

    def __init__(self, tokens: list[str], merges: list[tuple[str, str]], special: dict[str, int]):
        ids = {t: i for i, t in enumerate(tokens)}
        self.tokens, self.special = tokens, special
        self.size = len(tokens)
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        new = np.array([ids[a + b] for a, b in merges], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.pair_keys, self.pair_ranks, self.pair_new = key[order], order.astype(np.int64), new[order]
        letters = byte_letters()
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        self.byte_end_ids = np.array([ids[c + "</w>"] for c in letters], np.int64)
        spaced = [f" {t}".encode() for t in tokens]
        self.shown, self.shown_at, self.shown_len = _packed(spaced)
        self.digits, self.digits_at, self.digits_len = _packed([f" {i}".encode() for i in range(self.size)])
        self.splitter, self.odd, self.is_odd = None, None, None

    @classmethod
    @lru_cache(2)
    def read(cls, path: str) -> Vocabulary:
        return cls.parsed(Path(path).read_text())

    @classmethod
    def parsed(cls, text: str) -> Vocabulary:
        data = json.loads(text)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        by_id = {i: t for t, i in data["model"]["vocab"].items()} | {i: t for t, i in special.items()}
        out = cls([by_id[i] for i in range(max(by_id) + 1)], [tuple(m) for m in data["model"]["merges"]], special)
        # The vocabulary's normaliser and splitter, without its model.
        out.splitter = json.dumps(data | {"added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": {"a": 0}, "unk_token": "a"}})
        out.is_odd = odd_table(out.splitter)
        out.odd = odd_letters(out.is_odd)
        return out

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (UTF-8) and the number of each, merged exactly: always the pair of lowest rank, the leftmost first."""
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):  # words of like length together, 200,000 symbols at a time
            to = at + 1
            while to < len(order) and (to - at + 1) * size[order[to]] <= 200_000 and size[order[to]] <= 2 * size[order[at]] + 4:
                to += 1
            rows = order[at:to]
            if len(rows) == 1 and size[rows[0]] > 2000:
                ids = [np.array(self._one(words[rows[0]]), np.int64)]
                flat, n = ids[0], np.array([len(ids[0])])
            else:
                flat, n = self._block([words[i] for i in rows], size[rows])
            counts[rows] = n
            parts.append((rows, flat))
            at = to
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        out = np.zeros(int(starts[-1]), np.int64)
        for rows, flat in parts:
            n = counts[rows]
            where = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(len(flat))
            out[where] = flat
        return out, counts

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted merges, or -1."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), at, -1)

    def _block(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(words), int(size.max())
        grid = np.full((n, most), -1, np.int64)
        inside = np.arange(most) < size[:, None]
        grid[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        last = np.array([w[-1] for w in words])
        grid[np.arange(n), size - 1] = self.byte_end_ids[last]
        place = np.full((n, max(most - 1, 1)), -1, np.int64)
        if most > 1:
            place = self._ranks(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(n, most - 1)
        rank = np.where(place >= 0, self.pair_ranks[place], _NONE)
        size = size.copy()
        left = np.arange(n)
        columns = np.arange(most)
        while True:
            best = rank[left].argmin(1) if len(left) else left
            going = rank[left, best] != _NONE
            left, best = left[going], best[going]
            if not len(left):
                break
            g = grid[left]
            g[np.arange(len(left)), best] = self.pair_new[self._ranks(g[np.arange(len(left)), best], g[np.arange(len(left)), best + 1])]
            pull = np.minimum(columns + (columns > best[:, None]), most - 1)
            g = np.take_along_axis(g, pull, 1)
            size[left] -= 1
            g[np.arange(len(left)), size[left]] = -1
            grid[left] = g
            r = np.take_along_axis(rank[left], np.minimum(columns[:-1] + (columns[:-1] > best[:, None]), most - 2), 1)
            r[:, -1] = np.where(size[left] >= most, r[:, -1], _NONE)
            for k in (-1, 0):  # the pairs at either side of the new token
                c = best + k
                ok = (c >= 0) & (c + 1 < most)
                rows = np.flatnonzero(ok)
                p = self._ranks(g[rows, c[rows]], g[rows, c[rows] + 1])
                r[rows, c[rows]] = np.where(p >= 0, self.pair_ranks[p], _NONE)
            rank[left] = r
        return grid[grid >= 0], size

    def _one(self, word: bytes) -> list[int]:
        """The same for one very long word: a heap of pairs over a linked list."""
        import heapq

        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.byte_end_ids[word[-1]])
        after, before = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(pairs: list[int]) -> None:
            a = np.array([ids[i] for i in pairs], np.int64)
            b = np.array([ids[after[i]] for i in pairs], np.int64)
            for i, p in zip(pairs, self._ranks(a, b).tolist(), strict=True):
                if p >= 0:
                    heapq.heappush(heap, (int(self.pair_ranks[p]), i, ids[i], ids[after[i]], int(self.pair_new[p])))

        offer(list(range(len(ids) - 1)))
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer([x for x in (before[i], i) if x >= 0 and after[x] >= 0])
        return [x for x in ids if x >= 0]


def _packed(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in items], np.int64)
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(size) - size, size


class Lexicon:
    """A minimal acyclic automaton over UTF-8 bytes. The outputs on a word's arcs add up to its row; each row has ids."""

    FIELDS = ("keys", "targets", "outputs", "final", "id_starts", "ids", "start")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: list[bytes], vocabulary: Vocabulary) -> Lexicon:
        words = sorted(set(words))
        ids, counts = vocabulary.merged(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # States are made minimal from the end of the last word back to where the next word branches off.
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # of the last word: is it final, arcs so far

        def closed(depth: int, word: bytes) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1].append((word[len(path) - 1], register[key]))

        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            closed(common, last)
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
        closed(0, last)
        start = len(states)
        states.append((path[0][0], tuple(path[0][1])))
        below = [0] * len(states)  # words that end at or after each state; targets come before their sources
        keys, targets, outputs = [], [], []
        for s, (final, arcs) in enumerate(states):
            n = int(final)
            for label, to in arcs:
                keys.append(s * 256 + label)
                targets.append(to)
                outputs.append(n)
                n += below[to]
            below[s] = n
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        pick = lambda x: np.array(x, np.int64)[order]
        return cls(
            {
                "keys": pick(keys),
                "targets": pick(targets),
                "outputs": pick(outputs),
                "final": np.array([int(f) for f, _ in states], np.int64),
                "id_starts": np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]),
                "ids": ids,
                "start": np.array([start], np.int64),
            }
        )

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The row of each word, or -1; all words walk together, one byte at a time."""
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        body = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        row = np.zeros(n, np.int64)
        state = np.full(n, self.start[0])
        live = np.flatnonzero(size > 0)
        step = 0
        out = np.full(n, -1, np.int64)
        if not len(self.keys):
            return out
        while len(live):
            key = state[live] * 256 + body[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            row[live] += self.outputs[at]
            state[live] = self.targets[at]
            step += 1
            ended = size[live] == step
            done = live[ended]
            out[done] = np.where(self.final[state[done]] == 1, row[done], -1)
            live = live[~ended]
        return out

    def packed(self) -> bytes:
        """What a file of it holds: the number of entries of each array, then the arrays."""
        arrays = [np.ascontiguousarray(getattr(self, f), np.int64) for f in self.FIELDS]
        return b"".join(x.tobytes() for x in (np.array([len(x) for x in arrays], np.int64), *arrays))

    def save(self, path: str) -> None:
        Path(path).write_bytes(self.packed())

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        whole = np.memmap(path, np.int64, "r")
        sizes, at, arrays = whole[: len(cls.FIELDS)].tolist(), len(cls.FIELDS), {}
        for f, n in zip(cls.FIELDS, sizes, strict=True):
            arrays[f] = whole[at : at + n]
            at += n
        return cls(arrays)


class Encoder:
    """Encodes texts by the lexicon, else by merging; remembers raw words it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        specials = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.rules = None
        self._forget()

    def _forget(self) -> None:
        special = self.vocabulary.special
        self.known: dict[str, int] = {t: i for i, t in enumerate(special)}
        self.flat = np.array(list(special.values()), np.int64)
        self.count = np.ones(len(special), np.int64)
        self.begin = np.arange(len(special))

    def raw_words(self, text: str) -> list[str]:
        """What white space separates; special tokens stand alone."""
        if self.special is None or "<|" not in text:
            return split_raw(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.vocabulary.special else split_raw(part)
        return out

    def _odd_words(self, word: str) -> list[str]:
        """The words of a raw word with an odd letter, by the vocabulary's own rules."""
        self.rules = self.rules or Tokenizer.from_str(self.vocabulary.splitter)
        pieces = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(word))
        return [bytes(_BYTE_OF[c] for c in p).decode() for p, _ in pieces]

    def _learn(self, raw: list[str]) -> None:
        odd = odd_words(raw, self.vocabulary.is_odd) if self.vocabulary.is_odd is not None else []
        if odd:
            raw = list(set(raw).difference(odd)) + odd
        found = words_of(raw[: len(raw) - len(odd)])
        for w in odd:
            found += [*self._odd_words(w), "\n"]
        place = {w: i for i, w in enumerate(dict.fromkeys(found))}
        members = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
        line = place.pop("\n")
        ends = np.flatnonzero(members == line)
        coded = [w.encode() for w in place]
        rows = self.lexicon.rows(coded) if self.lexicon is not None and coded else np.full(len(coded), -1, np.int64)
        unseen, seen = np.flatnonzero(rows < 0), np.flatnonzero(rows >= 0)
        ids, counts = self.vocabulary.merged([coded[i] for i in unseen]) if len(unseen) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        begin, count = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        if self.lexicon is not None:
            begin[seen] = self.lexicon.id_starts[rows[seen]]
            count[seen] = self.lexicon.id_starts[rows[seen] + 1] - begin[seen]
            begin[unseen] += len(self.lexicon.ids)
            ids = np.concatenate([self.lexicon.ids, ids])
        begin[unseen] += np.cumsum(counts) - counts
        count[unseen] = counts
        begin, count = (np.insert(x, line, 0) for x in (begin, count))  # a line's end has no ids
        flat = gathered(ids, begin[members], count[members])
        n = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(count[members])[ends]]))
        self.known.update(zip(raw, range(len(self.known), len(self.known) + len(raw)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n) - n])
        self.flat = np.concatenate([self.flat, flat])
        self.count = np.concatenate([self.count, n])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (texts + 1)."""
        parts = [self.raw_words(t) for t in texts]
        raw = [w for p in parts for w in p]
        if len(self.known) > MEMORY_WORDS:
            self._forget()
        if new := set(raw).difference(self.known):
            self._learn(list(new))
        codes = np.fromiter(map(self.known.__getitem__, raw), np.int64, len(raw))
        flat = gathered(self.flat, self.begin[codes], self.count[codes])
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.count[codes])])
        return flat, total[np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts])]).astype(np.int64)]


def joined(packed: tuple[np.ndarray, np.ndarray, np.ndarray], flat: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """For each row the entries of its ids, joined by one space."""
    blob, at, size = packed
    n = size[flat]
    body = gathered(blob, at[flat], n).tobytes()
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    return [body[a + 1 : b] for a, b in zip(total[begin[:-1]].tolist(), total[begin[1:]].tolist(), strict=True)]


def decoded(vocabulary: Vocabulary, flat: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """UTF-8 text of each row of ids: without a decoder in the file, its tokens joined by one space, special ones included."""
    return joined((vocabulary.shown, vocabulary.shown_at, vocabulary.shown_len), flat, begin)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each normalised word in all documents: word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words: dict[str, int] = {}
            times = iter(raw.values())
            n = next(times, 0)
            for w in words_of(list(raw)):
                if w == "\n":
                    n = next(times, 0)
                else:
                    words[w] = words.get(w, 0) + n
            raw.clear()
            return pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        for b in batches:
            for first, size in _row_slices(b.column(0)):
                for t in b.column(0).slice(first, size).to_pylist():
                    raw.update(split_raw(t or ""))
                    if len(raw) > MEMORY_WORDS:
                        yield out()
        yield out()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, words: int) -> DataFrame:
    """At most `words` words of counts (word, n), the most frequent: of those of about the same frequency that don't all fit, a part by hash."""
    # Frequencies in steps of 2 ** (1 / 16): at most 1,024 rows reach the driver.
    step = F.floor(F.log2("n") * 16).cast("int")
    taken, chosen = 0, F.lit(True)
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room = (words - taken) / r["count"]
        part = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(0.95 * room * (1 << 20))
        taken += r["count"]
        if taken >= words:  # all steps above are taken whole
            chosen = (step > r["step"]) | ((step == r["step"]) & (part if room < 1 else F.lit(True)))
            break
    return counts.filter(chosen).select("word")


def lexicon_file(docs: DataFrame, vocabulary: Vocabulary, words: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compiles the most frequent words of docs, about `words` at most, and gives the file to all executors; returns its name."""
    counts = stored(word_counts(docs, text))
    lexicon = worked_out(_one_at_least(most_frequent(counts, words)), lambda rows: _compiled(rows, vocabulary))
    removed(counts)
    return _given(docs.sparkSession, lexicon, "lexicon")


def _one_at_least(words: DataFrame) -> DataFrame:
    return words.union(words.sparkSession.range(1).select(F.lit(None).cast("string")))


def _compiled(rows: pa.Table, vocabulary: Vocabulary) -> bytes:
    return Lexicon.compile([w.encode() for w in rows["word"].to_pylist() if w is not None], vocabulary).packed()


def _given(spark: SparkSession, content: bytes, kind: str) -> str:
    """Puts content into a file that the driver serves to the executors; returns its name."""
    name = f"{kind}-{uuid.uuid4().hex}"  # a context takes each name once
    at = Path(_folder()) / name
    at.write_bytes(content)
    spark.sparkContext.addFile(str(at))
    return name


@lru_cache(1)
def _folder() -> str:
    """The driver's folder of lexicons; it goes with the driver."""
    at = tempfile.mkdtemp(prefix="lexicon-")
    atexit.register(shutil.rmtree, at, True)
    return at


@lru_cache(1)
def vocabulary_of(name: str) -> Vocabulary:
    """The vocabulary in a file that the driver serves; a worker reads it once."""
    return pickle.loads(Path(SparkFiles.get(name)).read_bytes())


def encoder_of(name: str, vocabulary: str) -> Encoder:
    """A task's encoder; what it remembers goes with the task."""
    return Encoder(vocabulary_of(vocabulary), Lexicon.mapped(SparkFiles.get(name)))


def prepared(docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS, text: str = "text") -> tuple[str, str]:
    """Names of the files of the lexicon and of the vocabulary for docs. A task makes both, of a few MB each, from the vocabulary's file and the most frequent words; the driver only passes them on."""
    content = Path(vocabulary_path).read_text()

    def made(rows: pa.Table) -> tuple[bytes, bytes]:
        vocabulary = Vocabulary.parsed(content)
        return _compiled(rows, vocabulary), pickle.dumps(vocabulary)

    counts = stored(word_counts(docs, text))
    lexicon, vocabulary = worked_out(_one_at_least(most_frequent(counts, words)), made)
    removed(counts)
    return _given(docs.sparkSession, lexicon, "lexicon"), _given(docs.sparkSession, vocabulary, "vocabulary")


def encode(docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS, text: str = "text") -> DataFrame:
    """docs with ``token_ids array<int>`` and ``n_tokens long``."""
    name, vocabulary = prepared(docs, vocabulary_path, words, text)

    @F.arrow_udf("array<int>")
    def ids_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(name, vocabulary)
        for column in columns:
            parts = [pa.array([], pa.list_(pa.int32()))]
            for first, size in _row_slices(column):
                flat, begin = encoder.encode([x or "" for x in column.slice(first, size).to_pylist()])
                parts.append(pa.ListArray.from_arrays(begin.astype(np.int32), flat.astype(np.int32)))
            yield pa.concat_arrays(parts)

    return docs.drop("token_ids", "n_tokens").withColumn("token_ids", ids_of(F.col(text))).withColumn("n_tokens", F.size("token_ids").cast("long"))


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "token_ids") -> DataFrame:
    """encoded with ``decoded_text``: the text of its ids."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path))

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        rows = [np.asarray(x if x is not None else [], np.int64) for x in column.to_pylist()]
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in rows])]).astype(np.int64)
        return pa.array([x.decode() for x in decoded(vocabulary.value, np.concatenate([np.zeros(0, np.int64), *rows]), begin)], pa.string())

    return encoded.drop("decoded_text").withColumn("decoded_text", text_of(F.col(ids)))


def digests(docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded again."""
    name, vocabulary = prepared(docs, vocabulary_path, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = encoder_of(name, vocabulary), vocabulary_of(vocabulary)
        for b in batches:
            for first, size in _row_slices(b.column(1)):
                texts = [x or "" for x in b.column(1).slice(first, size).to_pylist()]
                flat, begin = encoder.encode(texts)
                ids = joined((v.digits, v.digits_at, v.digits_len), flat, begin)
                hexed = lambda rows: [hashlib.sha256(x).hexdigest() for x in rows]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, size), pa.array(np.diff(begin)), pa.array(hexed(ids), pa.string()), pa.array(hexed(decoded(v, flat, begin)), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _row_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of about _SLICE_CHARS bytes."""
    from bucketscope.llm.columnar import slices

    for first, _, offsets in slices(column, _SLICE_CHARS):
        yield first, len(offsets) - 1


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
