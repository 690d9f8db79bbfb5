"""Personal data inside free text (problem 1): found, and replaced with typed placeholders.

A linear-chain conditional random field labels the tokens of a sentence. Its features are
words and word shapes at nearby places, lists of name parts, the shape of a whole run of
digits, and the words on either side of it. It is trained in numpy from the labelled
table of `pii_labels` and decoded by Viterbi over batches of sentences of like length.

Sentences in which no digit group, no at sign or its spelling and no two capitalised words
stand hold no such data and are not decoded. Sentences that are alike but for their digits
are decoded once in a batch, since the features see only the shape of digits. Lines are
read in the consistent form of `lookalike`; positions are those of the stored text.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import io
import json
import re
import sys
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.llm import pii_labels
from loamworks.llm.lookalike import canonical_batch, slices
from loamworks.llm.pii_labels import KINDS, labelled_table
from loamworks.session import shared_dir

NAMES_MOST = 50_000  # name parts that the model may hold; a longer list is an error
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
NAME_WORDS = 7  # words of a person's name at most, particles and parts with hyphens counted
STATES = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
S = len(STATES)

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_RUN = re.compile(r"(?<![\d.])\d{2,3}(?:\.\d{2,4}){2,}(?![\d.])|(?:\+ ?|\()?\d(?:[ .()/-]{0,3}\d)*")
_MAIL = re.compile(r"[\w.+-]+(?: dot [\w.+-]+)* ?(?:@|[\[(] ?at ?[\])]|\bat\b(?= [\w-]+ dot\b)|\bAT\b(?= [\w-]+ DOT\b)) ?[\w-]+(?: ?(?:\.|[\[(] ?dot ?[\])]|\bdot\b|\bDOT\b) ?[\w-]+)+", re.I)
_AT = re.compile(r"[\[(] ?at ?[\])]|\bat\b.* dot ", re.I)
_SPLIT = re.compile(r"(?<=[a-zà-ÿ0-9%]{3}[.!?]) (?=[A-ZÀ-ÞА-ЯΑ-Ω\"¿])(?<!Blvd\. )(?<!Ave\. )(?<!Str\. )(?<!Prof\. )(?<!tel\. )(?<!Tel\. )")
_NAMES = re.compile(r"[^\W\d_a-z][\w'’]*[.,]?(?:-[^\W\d_][\w'’]*)*,?(?: (?:(?:d[aeiou]s?|van|von|de[lnr]|la|le|te[nr]?|zu[mr]?|al|el|bin|ibn|ben|y|e|af|av|mac|st\.?) ){0,3}|(?<=[.,]))[^\W\d_a-z]")
_DIGITS = str.maketrans("123456789", "0" * 9)

# The words and shapes at these places beside a token are features of it.
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)


def gate(sentence: str) -> bool:
    """Whether a sentence, its digits masked, may hold personal data. Errs on the side of decoding.

    A name has two capitalised words (or an initial) side by side; a phone 7 digits; an identity number 5
    digits that stand together or beside letters; an address a number beside a capitalised word or a box.
    """
    if "@" in sentence:
        return True
    digits = sentence.count("0")  # they are masked
    if digits >= 7 or digits >= 5 and _TIGHT.search(sentence):
        return True
    low = sentence.lower()
    if " dot " in low or "dot]" in low or "dot)" in low or "(at)" in low or "[at]" in low:
        return True
    if digits and _PLACE.search(sentence):
        return True
    return bool(_NAMES.search(sentence))


_TIGHT = re.compile(r"0{5}|[^\W\d_][ -]?0[0 -]{2,}[0 -]*[^\W\d_]?")
_PLACE = re.compile(r"\d[a-zA-Z]?,|\d (?:[NSEW]\. )?[^\W\d_a-z]|(?i:box|fach|apartado) \d|, 0|[^\W\d_]{3} 0{1,4}[a-z]?, ")


def _shape(word: str) -> str:
    if word[0].isdigit():
        return "0" * min(len(word), 6)
    if not word[0].isalpha():
        return word
    if len(word) == 1:
        return "X1" if word.isupper() else "x1"
    return "XX" if word.isupper() else "Xx" if word[0].isupper() else "xx" if word.islower() else "xX"


class Model:
    """Weights, and the lists that features look words up in."""

    def __init__(self, given: Sequence[str], family: Sequence[str]) -> None:
        self.given = {g.lower() for g in canonical_batch(given)[0]}
        self.family = {f.lower() for f in canonical_batch(family)[0]}
        self.ids: dict[tuple, int] = {}
        self.weights = np.zeros((1, S))
        self.move = np.zeros((S, S))
        self.first = np.zeros(S)
        self.frozen = False
        self.rows: dict[str, tuple] = {}

    def known(self, word: str) -> int:
        """0: in no list, 1: given name, 2: family name, 3: both, 4: initial, 5: capitalised, 6: all capitals, 7: else."""
        low = word.lower()
        listed = (low in self.given) + 2 * (low in self.family)
        if listed and not word.islower():
            return listed
        if word.isalpha():
            return 4 if len(word) == 1 and word.isupper() else 6 if word.isupper() else 5 if word[0].isupper() else 0
        return 7

    def _id(self, feature: tuple) -> int:
        at = self.ids.get(feature)
        if at is None:
            if self.frozen:
                return 0
            at = self.ids[feature] = len(self.ids) + 1
        return at

    def word_features(self, word: str, offset: int, rare: set[str] | None = None) -> list[int]:
        """Features that one word gives to a token `offset` places away."""
        low, shape, listed = word.lower(), _shape(word), self.known(word)
        out = [self._id(("s", offset, shape)), self._id(("n", offset, listed))]
        if not word[0].isdigit() and (rare is None or low not in rare):
            out.append(self._id(("w", offset, low)))
        if offset == 0 and word.isalpha():
            out += [self._id(("e", low[-3:])), self._id(("b", low[:3], shape)), self._id(("f", low[-2:], shape))]
        elif offset in (-1, 1) and word.isalpha():
            out.append(self._id(("e", offset, low[-3:])))
        return out

    def near_features(self, kinds: list[int], shapes: list[str], gaps: list[bool]) -> list[list[int]]:
        """Features of tokens by the lists and shapes of three tokens together, and by the blank before."""
        n = len(kinds)
        k = [8, 8, *kinds, 8, 8]
        s = ["", *shapes, ""]
        return [[self._id(("k", *k[i + 1 : i + 4])), self._id(("K", *k[i : i + 3])), self._id(("R", *k[i + 2 : i + 5])), self._id(("g", gaps[i], s[i + 1])), self._id(("S", *s[i : i + 3]))] for i in range(n)]

    def word_around_features(self, word: str) -> tuple[int, int]:
        """What the last word before, and the next word after, give to a token that may be part of a name."""
        return self._id(("pb", word)), self._id(("pa", word))

    def stretch_features(self, sentence: str, starts: list[int], words: list[str]) -> list[tuple[int, int]]:
        """(token, feature) by runs of digits, with the words on either side of a run, and by mail-like stretches."""
        out: list[tuple[int, int]] = []
        n = len(words)
        if "0" in sentence:
            for m in _RUN.finditer(sentence):
                text = m.group()
                digits = sum(map(str.isdigit, text))
                shape = text if len(text) <= 24 else f"{text[:12]}~{len(text) // 8}"
                lo, hi = bisect.bisect_left(starts, m.start()), bisect.bisect_left(starts, m.end())
                before = next((w.lower() for w in reversed(words[max(0, lo - 12) : lo]) if w.isalpha() and len(w) > 1), "")
                after = next((w.lower() for w in words[hi : hi + 12] if w.isalpha() and len(w) > 1), "")
                for j in range(lo, hi):
                    head = j == lo
                    out += [(j, self._id(("r", shape, head))), (j, self._id(("rb", before, _shape(words[j])))), (j, self._id(("rbr", before, shape))), (j, self._id(("ra", after))), (j, self._id(("rn", digits, head)))]
        if "@" in sentence or _AT.search(sentence):
            for m in _MAIL.finditer(sentence):
                lo, hi = bisect.bisect_left(starts, m.start()), bisect.bisect_left(starts, m.end())
                out += [(j, self._id(("m", j == lo))) for j in range(lo, min(hi, n))]
        return out

    def all_features(self, sentence: str, spans: list[tuple[int, int]], words: list[str]) -> list[list[int]]:
        """Features of tokens by their place, as they are trained."""
        n = len(words)
        kinds, shapes = [self.known(w) for w in words], [_shape(w) for w in words]
        gaps = [not i or spans[i][0] > spans[i - 1][1] for i in range(n)]
        out = self.near_features(kinds, shapes, gaps)
        for j, f in self.stretch_features(sentence, [a for a, _ in spans], words):
            out[j].append(f)
        around = [w.lower() if w.isalpha() and len(w) > 1 else "" for w in words]
        for i in range(n):
            if 1 <= kinds[i] <= 6:
                before = next((w for w in reversed(around[:i]) if w), "")
                after = next((w for w in around[i + 1 :] if w), "")
                out[i] += [self.word_around_features(before)[0], self.word_around_features(after)[1]]
        return out


def tokens(sentence: str) -> tuple[list[tuple[int, int]], list[str]]:
    found = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(sentence)]
    return [(a, b) for a, b, _ in found], [w for _, _, w in found]


_KINDS = np.full(0x110000, 255, np.uint8)  # of code points: 0 blank, 1 letter, 2 digit, 3 sign; 255 not looked up yet


def tokens_of(sentences: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all sentences end to end, with starts and ends within their sentence, and the place of each sentence's first."""
    text = "\n".join(sentences) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KINDS[codes]
    if (new := kind == 255).any():
        for cp in np.unique(codes[new]).tolist():
            ch = chr(cp)
            _KINDS[cp] = 0 if ch.isspace() else 3 if ch == "_" or not ch.isalnum() else 2 if ch.isdecimal() else 1
        kind = _KINDS[codes]
    sign, there = kind == 3, kind > 0
    change = np.concatenate([[True], kind[1:] != kind[:-1]])
    starts = np.flatnonzero(there & (change | sign))
    ends = np.flatnonzero(there & (np.concatenate([change[1:], [True]]) | sign)) + 1
    words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    begins = np.concatenate([[0], np.cumsum([len(s) + 1 for s in sentences])])
    first = np.searchsorted(starts, begins)
    shift = np.repeat(begins[:-1], np.diff(first))
    return words, starts - shift, ends - shift, first


def _sums(scores: np.ndarray, axis: int) -> np.ndarray:
    top = scores.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(scores - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(given: Sequence[str], family: Sequence[str], rounds: int = 8, rate: float = 0.35, batch: int = 64, penalty: float = 1e-5) -> Model:
    """The model from the labelled table, by gradient steps (AdaGrad) on the log likelihood of whole label sequences."""
    model = Model(given, family)
    rows = labelled_table(list(given), list(family))
    counts: dict[str, int] = {}
    parsed = []
    for text, spans in rows:
        masked = text.translate(_DIGITS)
        places, words = tokens(masked)
        tags = [0] * len(words)
        for a, b, kind in spans:
            base, begun = 1 + 2 * KINDS.index(kind), False
            for i, (x, _) in enumerate(places):
                if a <= x < b:
                    tags[i] = base + begun
                    begun = True
        for w in set(map(str.lower, words)):
            counts[w] = counts.get(w, 0) + 1
        parsed.append((masked, places, words, tags))
    rare = {w for w, n in counts.items() if n < 4}
    examples = []
    cache: dict[tuple[str, int], list[int]] = {}
    for masked, places, words, tags in parsed:
        feats = model.all_features(masked, places, words)
        for i in range(len(words)):
            for offset in OFFSETS:
                j = i + offset
                if 0 <= j < len(words):
                    key = (words[j], offset)
                    if key not in cache:
                        cache[key] = model.word_features(words[j], offset, rare)
                    feats[i] += cache[key]
                else:
                    feats[i].append(model._id(("edge", offset)))
        if words:
            examples.append((feats, tags))
    examples.sort(key=lambda e: len(e[1]))
    batches = [examples[i : i + batch] for i in range(0, len(examples), batch)]
    size = len(model.ids) + 1
    w, move, first = np.zeros((size, S)), np.zeros((S, S)), np.zeros(S)
    gw, gm, gf = np.full((size, S), 1e-2), np.full((S, S), 1e-2), np.full(S, 1e-2)
    rng = np.random.default_rng(3)
    packed = []
    for group in batches:
        n, t = len(group), len(group[-1][1])
        flat = np.concatenate([np.array(f, np.int64) for e in group for f in e[0]])
        owner = np.repeat(np.concatenate([b * t + np.arange(len(e[1])) for b, e in enumerate(group)]), [len(f) for e in group for f in e[0]])
        gold = np.zeros((n, t), np.int64)
        mask = np.zeros((n, t), bool)
        for b, e in enumerate(group):
            gold[b, : len(e[1])] = e[1]
            mask[b, : len(e[1])] = True
        used, local = np.unique(flat, return_inverse=True)
        from_cell = np.argsort(owner, kind="stable")
        packed.append((n, t, used, local[from_cell], owner[from_cell], gold, mask))
    for _ in range(rounds):
        for k in rng.permutation(len(packed)):
            n, t, used, local, owner, gold, mask = packed[k]
            rows_w = w[used]
            cut = np.flatnonzero(np.diff(owner, prepend=-1))
            emit = np.zeros((n * t, S))
            emit[owner[cut]] = np.add.reduceat(rows_w[local], cut, axis=0)
            emit = emit.reshape(n, t, S)
            alpha = np.empty((t, n, S))
            alpha[0] = emit[:, 0] + first
            for i in range(1, t):
                step = _sums(alpha[i - 1][:, :, None] + move[None], 1) + emit[:, i]
                alpha[i] = np.where(mask[:, i, None], step, alpha[i - 1])
            beta = np.zeros((t, n, S))
            for i in range(t - 2, -1, -1):
                step = _sums(move[None] + (emit[:, i + 1] + beta[i + 1])[:, None, :], 2)
                beta[i] = np.where(mask[:, i + 1, None], step, 0.0)
            total = _sums(alpha[-1], 1)
            post = np.exp(alpha + beta - total[None, :, None])
            grad = -post.transpose(1, 0, 2) * mask[..., None]
            at_n, at_t = np.nonzero(mask)
            grad[at_n, at_t, gold[at_n, at_t]] += 1
            d_move = np.zeros((S, S))
            for i in range(1, t):
                live = mask[:, i]
                if live.any():
                    both = alpha[i - 1][live][:, :, None] + move[None] + (emit[live, i] + beta[i][live])[:, None, :] - total[live][:, None, None]
                    d_move -= np.exp(both).sum(0)
                    np.add.at(d_move, (gold[live, i - 1], gold[live, i]), 1)
            cells = grad.reshape(n * t, S)[owner]
            order = np.argsort(local, kind="stable")
            starts = np.flatnonzero(np.diff(local[order], prepend=-1))
            d_w = np.add.reduceat(cells[order], starts, axis=0) - penalty * rows_w
            gw[used] += d_w**2
            w[used] += rate * d_w / np.sqrt(gw[used])
            gm += d_move**2
            move += rate * d_move / np.sqrt(gm)
            d_first = grad[:, 0].sum(0)
            gf += d_first**2
            first += rate * d_first / np.sqrt(gf)
    move[0, 2::2] = -50.0  # inside labels follow only their own kind
    for a in range(1, S):
        for b in range(2, S, 2):
            if b not in (a, a + 1) or (a % 2 == 0 and b != a):
                move[a, b] = -50.0
    first[2::2] = -50.0
    model.weights, model.move, model.first, model.frozen = w, move, first, True
    return model


def model_bytes(model: Model) -> bytes:
    """A trained model as one block: its arrays, features and lists, without pickled objects."""
    out = io.BytesIO()
    lists = json.dumps([sorted(model.given), sorted(model.family), [repr(f) for f in model.ids]])
    np.savez_compressed(out, weights=model.weights.astype(np.float32), move=model.move, first=model.first, lists=np.frombuffer(lists.encode("utf-8", "surrogatepass"), np.uint8))
    return out.getvalue()


def model_from(data: bytes) -> Model:
    model = Model((), ())
    with np.load(io.BytesIO(data), allow_pickle=False) as block:
        model.weights, model.move, model.first = block["weights"].astype(np.float64), block["move"], block["first"]
        given, family, features = json.loads(block["lists"].tobytes().decode("utf-8", "surrogatepass"))
    model.given, model.family, model.frozen = set(given), set(family), True
    model.ids = {ast.literal_eval(f): i + 1 for i, f in enumerate(features)}
    return model


_TRAINED: dict[str, Model] = {}


def _trained(given: tuple[str, ...], family: tuple[str, ...], spark=None) -> Model:
    """The model of the name lists: of this process, or stored in the shared folder by an earlier one, or trained (and stored)."""
    source = b"".join(Path(m.__file__).read_bytes() for m in (pii_labels, sys.modules[__name__]) if Path(m.__file__).exists())
    key = hashlib.blake2b(source + repr((given, family)).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    if key not in _TRAINED:
        path = f"{shared_dir(spark)}/loamworks-models/pii-{key}" if spark else ""
        try:
            stored = spark.read.parquet(path).collect() if spark else []
        except AnalysisException:  # there is none
            stored = []
        _TRAINED[key] = model_from(stored[0]["model"]) if stored else model_from(model_bytes(train(given, family)))
        if spark and not stored:
            spark.createDataFrame([(bytearray(model_bytes(_TRAINED[key])),)], "model binary").coalesce(1).write.mode("ignore").parquet(path)
    return _TRAINED[key]


class Tagger:
    """Decodes sentences with a model; sums of the weights of words are kept for as long as the worker lives."""

    KEPT = 400_000  # words whose sums are kept at once

    def __init__(self, model: Model) -> None:
        self.model = model
        self.weights = model.weights.astype(np.float32)
        self.columns = len(OFFSETS) + 2  # the words at the offsets, the last word before, the next word after
        self.edge = model.weights[[*(model._id(("edge", o)) for o in OFFSETS), *model.word_around_features("")]]
        # tables of the features of three tokens together, by number of list and of shape
        self.shapes = {s: i + 1 for i, s in enumerate(sorted({x for f in model.ids if f[0] == "S" for x in f[1:]} - {""}))}
        self.shapes[""] = 0
        m = self.m = len(self.shapes) + 1  # the last number is for shapes never seen in training
        self.near = {name: np.zeros((9, 9, 9), np.int64) for name in "kKR"}
        self.gap = np.zeros((2, m), np.int64)
        self.three = np.zeros((m, m, m), np.int64)
        for f, i in model.ids.items():
            if f[0] in self.near:
                self.near[f[0]][f[1:]] = i
            elif f[0] == "g":
                self.gap[int(f[1]), self.shapes.get(f[2], m - 1)] = i
            elif f[0] == "S":
                self.three[tuple(self.shapes[x] for x in f[1:])] = i
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.plain: dict[tuple, np.ndarray] = {}
        # row 0 stands for what lies beyond a sentence's ends
        self.table = np.zeros((4096, self.columns * S), np.float32)
        self.table[0] = self.edge.ravel()
        self.kind = np.zeros(4096, np.int64)
        self.kind[0] = 8
        self.shape = np.zeros(4096, np.int64)
        self.wordy = np.zeros(4096, bool)

    def _word(self, word: str) -> int:
        k = self.number.get(word)
        if k is None:
            k = self.number[word] = len(self.number) + 1
            if k == len(self.table):
                self.table, self.kind, self.shape, self.wordy = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.kind, self.shape, self.wordy))
            model, low, shape, listed = self.model, word.lower(), _shape(word), self.model.known(word)
            plain = self.plain.get((shape, listed))
            if plain is None:  # what all words of a shape and list have in common
                plain = self.plain[shape, listed] = np.concatenate([*(model.weights[[model._id(("s", o, shape)), model._id(("n", o, listed))]].sum(0) for o in OFFSETS), np.zeros(2 * S)])
            row = plain.copy()
            for j, f in self._own_features(word, low, shape):
                row[j * S : (j + 1) * S] += model.weights[f]
            self.table[k] = row
            self.kind[k] = listed
            self.shape[k] = self.shapes.get(shape, self.m - 1)
            self.wordy[k] = word.isalpha() and len(word) > 1
        return k

    def _own_features(self, word: str, low: str, shape: str) -> list[tuple[int, int]]:
        """(column, feature) of a word beyond its shape and list, those that training has seen."""
        get, zero, out = self.model.ids.get, OFFSETS.index(0), []
        if not word[0].isdigit():
            out = [(j, f) for j, o in enumerate(OFFSETS) if (f := get(("w", o, low)))]
        if word.isalpha():
            tail = low[-3:]
            for j, feature in ((zero, ("e", tail)), (zero, ("b", low[:3], shape)), (zero, ("f", low[-2:], shape)), (zero - 1, ("e", -1, tail)), (zero + 1, ("e", 1, tail))):
                if f := get(feature):
                    out.append((j, f))
        n = len(OFFSETS)
        return out + [(n + j, f) for j, name in enumerate(("pb", "pa")) if (f := get((name, low)))]

    def decode(self, sentences: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each sentence, whose digits are masked."""
        if len(self.number) > self.KEPT:
            self._clear()
        words, starts, ends, first = tokens_of(sentences)
        get, number = self.number.get, self._word
        numbers = np.array([k if (k := get(x)) is not None else number(x) for x in words], np.int64)
        length = np.diff(first)
        out: list[list[tuple[int, int, str]]] = [[] for _ in sentences]
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        begin = 0
        while begin < len(order):
            end = begin
            while end < len(order) and (end == begin or length[order[end]] * (end - begin + 1) <= 60_000):
                end += 1
            self._group(order[begin:end], sentences, words, numbers, starts, ends, first, out)
            begin = end
        return out

    def _group(self, group: np.ndarray, sentences: list[str], texts: list[str], numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, out: list) -> None:
        model, n = self.model, len(group)
        length = (first[1:] - first[:-1])[group]
        t = int(length[-1])
        words = np.zeros((n, t + 6), np.int64)
        gaps = np.ones((n, t), np.int64)
        rows = np.repeat(np.arange(n), length)
        cols = np.arange(rows.size) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(first[group], length) + cols
        words[rows, cols + 3] = numbers[at]
        gaps[rows, cols] = (cols == 0) | (starts[at] > ends[np.maximum(at - 1, 0)])
        cell: list[int] = []
        flat: list[int] = []
        for b, i in enumerate(group.tolist()):
            sentence = sentences[i]
            if "0" in sentence or "@" in sentence or "at" in sentence or "AT" in sentence:
                lo, hi = first[i], first[i + 1]
                for j, f in model.stretch_features(sentence, starts[lo:hi].tolist(), texts[lo:hi]):
                    cell.append(b * t + j)
                    flat.append(f)
        there = words > 0
        kind = self.kind[words][:, 1:-1]
        shape = self.shape[words][:, 2:-2]
        w = self.weights
        k = [kind[:, j : j + t] for j in range(5)]
        emit = w[self.near["k"][k[1], k[2], k[3]]] + w[self.near["K"][k[0], k[1], k[2]]] + w[self.near["R"][k[2], k[3], k[4]]]
        emit += w[self.gap[gaps, shape[:, 1:-1]]] + w[self.three[shape[:, :t], shape[:, 1:-1], shape[:, 2:]]]
        for j in range(len(OFFSETS)):
            emit += self.table[words[:, j : j + t], j * S : (j + 1) * S]
        # the last word before and the next word after each token that may be part of a name
        own = words[:, 3:-3]
        wordy = there[:, 3:-3] & self.wordy[own]
        place = np.arange(t)
        last = np.maximum.accumulate(np.where(wordy, place, -1), axis=1)
        last = np.concatenate([np.full((n, 1), -1), last[:, :-1]], axis=1)
        after = np.minimum.accumulate(np.where(wordy, place, t)[:, ::-1], axis=1)[:, ::-1]
        after = np.concatenate([after[:, 1:], np.full((n, 1), t)], axis=1)
        maybe = (k[2] >= 1) & (k[2] <= 6) & there[:, 3:-3]
        rows, cols = np.nonzero(maybe)
        for j, (at, none) in enumerate(((last[rows, cols], -1), (after[rows, cols], t))):
            c = (len(OFFSETS) + j) * S
            emit[rows, cols] += np.where((at != none)[:, None], self.table[own[rows, np.clip(at, 0, t - 1)], c : c + S], self.edge[len(OFFSETS) + j])
        if cell:
            at = np.array(cell)
            turn = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.diff(at[turn], prepend=-1))
            emit.reshape(n * t, S)[at[turn][heads]] += np.add.reduceat(w[np.array(flat)[turn]], heads, axis=0)
        path = _viterbi(emit, model.first, model.move, length)
        for b in np.flatnonzero(path.any(1)):
            i = group[b]
            out[i] = _spans(path[b, : length[b]], starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist())


def _viterbi(emit: np.ndarray, first: np.ndarray, move: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best states of each row; rows stand in order of length."""
    n, t, _ = emit.shape
    score = emit[:, 0] + first
    back = np.zeros((t, n, S), np.int8)
    rows = np.arange(n)
    for k in range(1, t):
        lo = int(np.searchsorted(length, k, side="right"))  # rows longer than k
        step = score[lo:, :, None] + move[None]
        best = step.argmax(1)
        back[k, lo:] = best
        score[lo:] = np.take_along_axis(step, best[:, None], 1)[:, 0] + emit[lo:, k]
    state = score.argmax(1)
    path = np.zeros((n, t), np.int64)
    for k in range(t - 1, -1, -1):
        on = length > k
        path[on, k] = state[on]
        if k:
            state = np.where(on, back[k, rows, state], state)
    return path


def _spans(tags: np.ndarray, starts: list[int], ends: list[int]) -> list[tuple[int, int, str]]:
    out, k = [], 0
    while k < len(tags):
        j = k + 1
        if tags[k]:
            kind = (tags[k] - 1) // 2
            while j < len(tags) and tags[j] == 2 + 2 * kind:
                j += 1
            out.append((starts[k], ends[j - 1], KINDS[kind]))
        k = j
    return out


def _names_in(text: str, at: int) -> list[tuple[int, int, str]]:
    """Names in a list of names: whole ones, or a family name, a comma and a given name."""
    out = []
    for piece in _BETWEEN.finditer(text):
        base = piece.start(1)
        parts = [(base + p.start() + len(p.group()) - len(p.group().lstrip()), base + p.end(), len(_WORD.findall(p.group()))) for p in re.finditer(r"[^,]+", piece.group(1)) if p.group().strip()]
        k = 0
        while k < len(parts):
            lo, hi, words = parts[k]
            family = words == 1 or bool(_PARTICLE.match(text[lo:hi]))
            k += 1
            if family and k < len(parts) and parts[k][2] <= 2:
                hi, words, k = parts[k][1], words + parts[k][2], k + 1
            if words >= 2 and any(c in text[lo:hi] for c in " ,"):
                out.append((at + lo, at + lo + len(text[lo:hi].rstrip()), "name"))
    return out


def _checked(form: str, lo: int, hi: int, kind: str) -> list[tuple[int, int, str]]:
    """Exact check of a found span: nothing, the span with what belongs to its start, or the names that a list holds."""
    text = form[lo:hi]
    if kind == "name":
        return [] if any(map(str.isdigit, text)) else [n for n in _names_in(text, lo) if len(_WORD.findall(form[n[0] : n[1]])) <= NAME_WORDS]
    before = form[form.rfind("\n", 0, lo) + 1 : lo]
    if kind == "email":
        if not (re.search(r"@|\bat\b", text, re.I) and re.search(r"\.|dot", text, re.I)):
            return []
        lo -= len(re.search(r"[\w.+-]*$", before).group())
    elif sum(map(str.isdigit, text)) < {"phone": 7, "id_number": 5, "address": 1}[kind]:
        return []
    elif kind == "address":
        lo -= len((_NUMBER_BEFORE if _STREET_FIRST.match(text) else _UNIT_BEFORE).search(before).group())
    return [(lo, hi, kind)]


_WORD = re.compile(r"[^\W\d_]+")
_BETWEEN = re.compile(r"(?:^| (?:and|und|et|y) )((?:(?! (?:and|und|et|y) ).)+)", re.S)
_STREET_FIRST = re.compile(r"[NSEW]\. |(?:rue|quai|avenue|chemin) ", re.I)  # forms that begin with a number
_NUMBER_BEFORE = re.compile(r"(?:(?:flat|unit|apt|suite) \d+, )?(?:\d+[a-z]?(?: bis)?,? )?$", re.I)
_UNIT_BEFORE = re.compile(r"(?:(?:flat|unit|apt|suite) \d+, )?$", re.I)
_PARTICLE = re.compile(r"(?i)(?:de|van|von|del|di|da|la|le|der) ")
def _masked(text: str) -> str:
    """The text with every ASCII digit as 0; a few passes of a fast search beat one of a slow map."""
    for digit in "123456789":
        if digit in text:
            text = text.replace(digit, "0")
    return text


def find_batch(texts: Sequence[str | None], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans of personal data of each stored text; none for null and empty texts."""
    forms, where = canonical_batch(texts, places=True)
    wanted: dict[str, int] = {}
    seen: list[tuple[int, int, int]] = []  # text, place in its form, sentence
    for i, form in enumerate(forms):
        if not form:
            continue
        at = 0
        for line in _masked(form).split("\n"):
            left = 0
            ended = ". " in line or "? " in line or "! " in line
            for cut in [*(m.start() for m in _SPLIT.finditer(line)), len(line)] if ended else (len(line),):
                masked = line[left:cut]
                k = wanted.get(masked)
                if k is None:
                    k = wanted[masked] = len(wanted) if gate(masked) else -1
                if k >= 0:
                    seen.append((i, at + left, k))
                left = cut + 1
            at += len(line) + 1
    masks = [m for m, k in wanted.items() if k >= 0]
    number = {k: p for p, k in enumerate(k for k in wanted.values() if k >= 0)}
    spans = tagger.decode(masks)
    out: list[list[tuple[int, int, str]]] = [[] for _ in forms]
    for i, at, k in seen:
        for a, b, kind in spans[number[k]]:
            for lo, hi, checked in _checked(forms[i], at + a, at + b, kind):
                if where[i] is not None:
                    lo, hi = int(where[i][lo]), int(where[i][hi - 1]) + 1
                out[i].append((lo, hi, checked))
    return out


def _tagger_for(spark, names: DataFrame):
    """The trained model, sent to each executor once. The list of name parts is checked to be small."""
    listed = names.filter(F.col("token").isNotNull()).select("token", "kind").distinct().limit(NAMES_MOST + 1).collect()
    if len(listed) > NAMES_MOST:
        raise ValueError(f"more than {NAMES_MOST} name parts")
    given = tuple(sorted(r["token"] for r in listed if r["kind"] == "given"))
    family = tuple(sorted(r["token"] for r in listed if r["kind"] == "family"))
    return spark.sparkContext.broadcast(_trained(given, family, spark))


_LIVE: list[Tagger] = []


def _live(sent) -> Tagger:
    """The worker's tagger of a sent model."""
    if not _LIVE or _LIVE[0].model is not sent.value:
        _LIVE[:] = [Tagger(sent.value)]
    return _LIVE[0]


def found(fetches: DataFrame, cards: DataFrame, names: DataFrame) -> DataFrame:
    """field, rec_id, item_no, kind, start_pos of all personal data in raw_text and in the items of content.

    Null, empty texts and items give no row; texts of any length are read whole. Rows are not shuffled.
    """
    sent = _tagger_for(fetches.sparkSession, names)
    items = cards.select(F.lit("content").alias("field"), F.col("card_id").cast("long").alias("rec_id"), F.posexplode("content").alias("item_no", "text"))
    texts = fetches.select(F.lit("raw_text").alias("field"), F.col("result_id").cast("long").alias("rec_id"), F.lit(0).alias("item_no"), F.col("raw_text").alias("text"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _live(sent)
        for b in (part for batch in batches for part in slices(batch, "text", 8_000_000)):
            spans = find_batch(b["text"].tolist(), tagger)
            rows = np.repeat(np.arange(len(b)), [len(x) for x in spans])
            keys = b[["field", "rec_id", "item_no"]].iloc[rows].reset_index(drop=True)
            yield keys.assign(kind=pd.Series([k for x in spans for _, _, k in x], dtype=object), start_pos=np.array([a for x in spans for a, _, _ in x], np.int32))

    schema = "field string, rec_id long, item_no int, kind string, start_pos int"
    both = [x.filter(F.length("text") > 0).mapInPandas(find, schema) for x in (texts, items)]
    return both[0].unionByName(both[1])


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """A text with each span replaced by its kind's placeholder."""
    out, at = [], 0
    for lo, hi, kind in sorted(spans):
        if lo >= at:
            out += [text[at:lo], PLACEHOLDERS[kind]]
            at = hi
    return "".join(out) + text[at:]


def redact(column: Column, sent) -> Column:
    """A text column with placeholders; null stays null, all else stays as stored."""

    @F.pandas_udf(T.StringType())
    def fill(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = _live(sent)
        for s in batches:
            texts = s.tolist()
            yield pd.Series([t if not x else redact_text(t, x) for t, x in zip(texts, find_batch(texts, tagger))], index=s.index, dtype=object)

    return fill(column)


def redacted(table: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """The table with `text` (a text or an array of texts) redacted; the other columns stay."""
    sent = _tagger_for(table.sparkSession, names)
    if not isinstance(table.schema[text].dataType, T.ArrayType):
        return table.withColumn(text, redact(F.col(text), sent))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def fill(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = _live(sent)
        for s in batches:
            rows = [None if x is None else list(x) for x in s.tolist()]
            flat = [t for x in rows if x is not None for t in x]
            done = iter([t if not p else redact_text(t, p) for t, p in zip(flat, find_batch(flat, tagger))])
            yield pd.Series([None if x is None else [next(done) for _ in x] for x in rows], index=s.index, dtype=object)

    return table.withColumn(text, fill(F.col(text)))
