"""BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of a word. A proposal is what BPE gives exactly
if each adjacent pair of tokens is what BPE gives for that pair alone; that test runs on
arrays of pairs, for all new words of a batch at once. Words with a pair that fails are
merged exactly.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from struct import Struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hrefsieve.llm.tables import slices

#: words whose tokens a task remembers
MEMO = 150_000
NEVER = 1 << 30
#: words of fewer tokens than that are packed without an array
PACKED = 32


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: classes of the pattern, by the library and by ``regex``
CLASSES = {r"\p{L}": r"\p{L}", r"\p{N}": r"\p{N}", r"\s": r"\p{White_Space}"}


def _as_class(points: list[int]) -> str:
    """Sorted code points as the ranges of a character class."""
    starts = [c for c, before in zip(points, [-9, *points], strict=False) if c != before + 1]
    ends = [c for c, after in zip(points, [*points[1:], -9], strict=True) if c + 1 != after]
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in zip(starts, ends, strict=True))


def library_letters(pattern: str) -> tuple[str, str, dict[int, str]]:
    """The pattern with the library's own letters, numbers and white space spelt out, the class
    of characters that ``regex`` or Python take for something else, and those among them
    that the library lower-cases or composes in another way.

    Each knows some version of Unicode. The library is asked once, on the driver, about
    every code point, some thousands at a time: runs of a class in a text of them are its ranges.
    """
    from tokenizers import Regex, normalizers
    from tokenizers.pre_tokenizers import Split

    splits = {name: Split(Regex(f"{name}+"), "removed", invert=True) for name in CLASSES}  # they stand in brackets only
    normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    theirs: dict[str, list[int]] = {name: [] for name in CLASSES}
    other: set[int] = set()
    lower: dict[int, str] = {}
    for start in range(0, 0x110000, 0x1000):
        points = [c for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000 and c != 1]
        text = "".join(map(chr, points))
        for name, ours in CLASSES.items():
            found = [points[k] for _, (a, b) in splits[name].pre_tokenize_str(text) for k in range(a, b)]
            theirs[name] += found
            other.update(set(found) ^ set(map(ord, "".join(regex.findall(f"{ours}+", text)))))
        normal = normalizer.normalize_str("\x01".join(text)).split("\x01")
        lower |= {c: n for c, n in zip(points, normal, strict=bool(points)) if points and n != _normal(chr(c))}
    for name, found in theirs.items():
        pattern = pattern.replace(name, _as_class(found))
    return pattern, _as_class(sorted(other | lower.keys())), lower


def _normal(text: str) -> str:
    """Composed, and lower case letter by letter: a final sigma isn't told apart."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def load_vocabulary(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs. Its size is the vocabulary's."""
    spec = json.loads(Path(path).read_text("utf-8"))
    model = spec["model"]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
    expected = (model["type"], split["behavior"], split["invert"], spec["decoder"], normal)
    if expected != ("BPE", "Removed", True, None, ["NFC", "Replace", "Lowercase"]):
        raise ValueError(f"not a BPE tokenizer of whole lower-case words: {expected}")
    exact, disputed, lower = library_letters(split["pattern"]["Regex"])
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]],
        "suffix": model["end_of_word_suffix"],
        "pattern": split["pattern"]["Regex"],
        "exact": exact,
        "disputed": disputed,
        "lower": lower,
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class WordBpe:
    """Encodes and decodes with one vocabulary, in one task."""

    def __init__(self, spec: dict):
        self.suffix, self.special = spec["suffix"], spec["special"]
        vocab = spec["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank = {pair: k for k, pair in reversed(list(enumerate(spec["merges"])))}
        self.letters = "".join(byte_letters())
        pattern = spec["pattern"]
        for theirs, ours in CLASSES.items():
            pattern = pattern.replace(theirs, ours)
        self.pattern, self.exact, self.lower = regex.compile(pattern), re.compile(spec["exact"]), spec["lower"]
        self.disputed = re.compile(f"[{spec['disputed']}]") if spec["disputed"] else None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.vocab = vocab
        #: ids of words, as little-endian 32-bit integers, and how their tokens are spelt
        self.memo: dict[str, bytes] = {}
        self.spelt: dict[str, str] = {}
        self.older: tuple[dict[str, bytes], dict[str, str]] = {}, {}
        self._derive(spec["merges"])

    def _derive(self, merges: list[tuple[str, str]]) -> None:
        """How BPE makes each token: rank and parts of its last merge.

        A token that BPE never makes of its own letters can't stand in any result; greedy
        matching leaves it out.
        """
        size = max(self.vocab.values()) + 1
        self.made = np.full(size, -1, np.int64)  # rank of the last merge, -1 for letters
        self.left, self.right = np.arange(size), np.arange(size)
        usable = {}
        for token, i in self.vocab.items():
            letters = self._letters(token)
            if len(letters) == 1:
                usable[token] = i
        for k, (a, b) in enumerate(merges):
            token = a + b
            if token in usable or a not in usable or b not in usable:
                continue
            if self.merge(self._letters(token)) != [token]:
                continue
            i = usable[token] = self.vocab[token]
            self.made[i], self.left[i], self.right[i] = k, self.vocab[a], self.vocab[b]
        self._list_usable(usable)
        pairs = {(self.vocab[a] * size + self.vocab[b]): k for (a, b), k in self.rank.items() if a in self.vocab and b in self.vocab}
        keys = np.array(sorted(pairs), np.int64)
        self.size, self.pair_keys, self.pair_ranks = size, keys, np.array([pairs[int(k)] for k in keys], np.int64)
        #: the same for one word at a time: rank of a pair of ids, and the id that a merge makes
        self.pair_rank = pairs
        self.makes = [self.vocab.get(a + b) for a, b in merges]
        letters = {*self.letters, *(c + self.suffix for c in self.letters)}
        self.by_ids = letters <= self.vocab.keys() and None not in self.makes and len(pairs) == len(self.rank)

    def _list_usable(self, usable: dict[str, int]) -> None:
        """Tokens within words, tokens that end words (spelt without the end), and the lengths
        worth trying where a word goes on with certain three letters, longest first."""
        cut = len(self.suffix)
        ends = {t: i for t, i in usable.items() if t.endswith(self.suffix) and t != self.suffix}
        self.inner = {t: i for t, i in usable.items() if t not in ends}
        self.final = {t[:-cut] if cut else t: i for t, i in ends.items()}
        self.longest_final = max(map(len, self.final), default=0)
        lengths: dict[str, set[int]] = {}
        for t in self.inner:
            if len(t) >= 3:
                lengths.setdefault(t[:3], set()).add(len(t))
        self.lengths = {start: (*sorted(found, reverse=True), 2, 1) for start, found in lengths.items()}

    def _letters(self, token: str) -> list[str]:
        """The letters of a token; the end of a word belongs to its last letter."""
        if token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Exact BPE: the pair that was learnt first is merged first, leftmost first."""
        get = self.rank.get
        parts = list(parts)
        ranks = [get(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), NEVER)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), NEVER)
        return parts

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does BPE give exactly these two tokens for each pair's letters?

        Walks back over the merges that made both tokens, last merge first: if at some
        moment the two parts that touched had a merge of an earlier rank than the one
        about to happen, BPE would have joined them. A merge of equal rank goes to the
        left one first, so a right part is held to the rank itself.
        """
        a, b = a.copy(), b.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NEVER, np.int64)
        while len(live):
            x, y = a[live], b[live]
            keys = x * self.size + y
            at = np.searchsorted(self.pair_keys, keys)
            at[at == len(self.pair_keys)] = 0
            joined = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)
            bad = joined < limit[live]
            good[live[bad]] = False
            ra, rb = self.made[x], self.made[y]
            done = bad | ((ra < 0) & (rb < 0))
            back_left = ~done & (ra > rb)
            back_right = ~done & ~back_left
            i = live[back_left]
            limit[i], a[i] = self.made[a[i]], self.right[a[i]]
            i = live[back_right]
            limit[i], b[i] = self.made[b[i]] + 1, self.left[b[i]]
            live = live[~done]
        return good

    def _greedy(self, word: str, out: list[int]) -> bool:
        """Add the longest usable token at each place, the last one with the end of the word. Is there one everywhere?"""
        at, n = 0, len(word)
        inner, final, longest, lengths = self.inner.get, self.final.get, self.longest_final, self.lengths.get
        while at < n:
            if n - at <= longest and (i := final(word[at:])) is not None:
                out.append(i)
                break
            for size in lengths(word[at : at + 3], (2, 1)):
                if at + size < n and (i := inner(word[at : at + size])) is not None:
                    out.append(i)
                    at += size
                    break
            else:
                return False
        return True

    def _merged(self, spelt: str) -> list[int]:
        """Ids of a word by exact merging; the same as ``merge``, on ids instead of letters."""
        if not self.by_ids:
            return [self.vocab[t] for t in self.merge([*spelt[:-1], spelt[-1] + self.suffix])]
        get, size, makes = self.pair_rank.get, self.size, self.makes
        parts = [*map(self.vocab.__getitem__, spelt[:-1]), self.vocab[spelt[-1] + self.suffix]]
        ranks = [get(a * size + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            made = parts[at] = makes[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] * size + made, NEVER)
            if at < len(ranks):
                ranks[at] = get(made * size + parts[at + 1], NEVER)
        return parts

    def learn(self, words: set[str]) -> None:
        """Tokens of new words, as the pattern cut them.

        All guesses lie in one list: an object for each word would keep the garbage collector busy.
        """
        letters, spell = self.letters, codecs.charmap_decode
        guessed: list[str] = []
        ends: list[int] = []
        merged: list[str] = []
        flat: list[int] = []
        for w in words:
            if self._greedy(w if w.isascii() and w.isprintable() else spell(w.encode("utf-8"), "strict", letters)[0], flat):
                guessed.append(w)
                ends.append(len(flat))
            else:
                del flat[ends[-1] if ends else 0 :]
                merged.append(w)
        tokens = np.array(flat, np.int64)
        if len(tokens) > 1:
            word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            inner = word[1:] == word[:-1]
            pairs, back = np.unique(tokens[:-1][inner] * self.size + tokens[1:][inner], return_inverse=True)
            good = self.compatible(pairs // self.size, pairs % self.size)[back]
            failed = set(word[1:][inner][~good].tolist())
        else:
            failed = set()
        packed, start = tokens.astype("<u4").tobytes(), 0
        for k, (w, end) in enumerate(zip(guessed, ends, strict=True)):
            if k in failed:
                merged.append(w)
            else:
                self.memo[w] = packed[4 * start : 4 * end]
                self.spelt[w] = self.decode(flat[start:end])
            start = end
        pack = [Struct(f"<{n}I").pack for n in range(PACKED)]
        for w in merged:
            ids = self._merged(w if w.isascii() and w.isprintable() else spell(w.encode("utf-8"), "strict", letters)[0])
            self.memo[w] = pack[len(ids)](*ids) if len(ids) < PACKED else np.array(ids, "<u4").tobytes()
            self.spelt[w] = self.decode(ids)

    def words(self, text: str) -> list[str]:
        """Normal form, then the pieces that the pattern keeps."""
        # The pattern keeps no white space, so which one parts two pieces makes no difference.
        if text.isascii() or self.disputed is None or not self.disputed.search(text):
            return self.pattern.findall(_normal(text))
        return self.exact.findall(_normal(text).translate(self.lower))

    def _pieces(self, texts: list[str]) -> list[list]:
        """Words of each text, all of them learnt; every second piece is a special token instead."""
        cut_texts = []
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            cut_texts.append([p if k % 2 else self.words(p) for k, p in enumerate(parts)])
        here = set().union(*(p for parts in cut_texts for p in parts[::2]))
        if len(self.memo) > MEMO:  # words that are still in use come back from the older half
            self.older = self.memo, self.spelt
            self.memo, self.spelt = {}, {}
        missing = here.difference(self.memo)
        for w in missing & self.older[0].keys():
            self.memo[w], self.spelt[w] = self.older[0][w], self.older[1][w]
        self.learn(missing.difference(self.memo))
        return cut_texts

    def encode_packed(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids of each text, as little-endian 32-bit integers, and the text they decode to."""
        out, pieces = [], self._pieces(texts)
        ids, spelt = self.memo.__getitem__, self.spelt.__getitem__
        for parts in pieces:
            packed, words = [], []
            for k, p in enumerate(parts):
                if k % 2:
                    packed.append(self.special[p].to_bytes(4, "little"))
                    words.append(p)
                else:
                    packed.extend(map(ids, p))
                    words.extend(map(spelt, p))
            out.append((b"".join(packed), " ".join(words)))
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [np.frombuffer(packed, "<u4").tolist() for packed, _ in self.encode_packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """Tokens as they are spelt, with a space between: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


_READY: dict[str, WordBpe] = {}


def _ready(spec) -> WordBpe:
    """The encoder of a broadcast vocabulary; a Python worker sets it up once for all its tasks."""
    if spec.id not in _READY:
        _READY.clear()
        _READY[spec.id] = WordBpe(spec.spec.value)
    return _READY[spec.id]


class _Given:
    """A vocabulary, sent once to each executor. A vocabulary file's size bounds it."""

    def __init__(self, docs: DataFrame, path: str):
        self.spec = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
        self.id = f"{path} {uuid.uuid4().hex}"


def _encode(spec: _Given) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(spec)
        for batch in slices(batches):
            packed, decoded = zip(*bpe.encode_packed([t or "" for t in batch.column("text").to_pylist()]), strict=True)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(ids) // 4 for ids in packed], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded]),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(spec: _Given) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(spec)
        for batch in slices(batches):
            packed = [ids for ids, _ in bpe.encode_packed([t or "" for t in batch.column("text").to_pylist()])]
            ends = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in packed])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return run


def _texts(spec: _Given) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(spec)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every text with the tokenizer file at ``path`` (on the driver).

    One row for each row; a null text is empty and has no ids. Nothing moves between
    tasks. Special tokens that occur in a text are their ids. Other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_ids(_Given(docs, path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(_Given(encoded, path)), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (little-endian, 32 bits) and of the decoded text.

    The same as ``encode`` and ``decode`` in one pass, for comparing encodings.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_encode(_Given(docs, path)), schema)
