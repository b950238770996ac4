"""Personal data: fixed patterns plus a linear-chain CRF over word-shape features.

The patterns give the base spans. The CRF is trained on a small labelled table
(``labelled_examples`` or one with the same columns) and adds spans that the
patterns miss, such as telephone numbers without a plus sign. A word without a
digit or an ``@`` can only be outside of a span; that hard constraint cuts the
chain of a text into short runs which are decoded exactly and independently, so
Viterbi works on padded batches of runs in numpy instead of word by word.

All steps take time in proportion to the text: each pattern reads a run of its
characters once, words and their neighbours are taken whole, and runs are
decoded in batches of bounded size. A feature may be coarse (digit counts from
20 on are one value), but no part of a text is cut off.

Edge cases: a null text counts as empty and has no span; spans are counted in
code points with exclusive ends; spans of two kinds may share a start and are
ordered by kind; a very long text, word or run of digits is read like any other;
repeated documents give repeated rows; a null doc_id stays null; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.batches import slices

# The kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Whole chains of dotted numbers: the leftmost matches take four at a time.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, place of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _is_octet(digits: str) -> bool:
    """Whether digits are a number of at most 255; leading zeros do not count."""
    own = digits.lstrip("0")
    return len(own) < 3 or len(own) == 3 and own <= "255"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Pattern spans, leftmost and non-overlapping within each kind."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:  # the local part is the run of its characters just before the sign
        m, lo = _DOMAIN.match(text, at), at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if m and lo < at:
            out.append((lo, 0, done := m.end()))
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        parts = [(p.start(), p.end()) for p in _NUMBER.finditer(text, m.start(), m.end())]
        for k in range(0, len(parts) - 3, 4):
            if all(_is_octet(text[lo:hi]) for lo, hi in parts[k : k + 4]):
                out.append((parts[k][0], 1, parts[k + 3][1]))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the CRF ---------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_SIZE = 1 << 13
_CELLS = 1 << 14  # padded words of a batch of runs
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D]+")
_SHAPES = str.maketrans(
    {**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}
)
_CUES = re.compile(r"[^a-z]+")


def _shape(word: str) -> str:
    return word.translate(_SHAPES)


def _slot(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % _SIZE


def word_features(before: str, word: str, after: str) -> list[int]:
    """Hashed features of a word: its shape long and short, digit count, marks, and its neighbours' shapes."""
    shape = _shape(word)
    short = re.sub(r"(.)\1+", r"\1", shape)
    count = sum("0" <= c <= "9" for c in word)
    marks = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", shape))))
    near = [re.sub(r"(.)\1+", r"\1", _shape(w)) for w in (before, after)]
    names = (
        f"shape={shape}", f"short={short}", f"digits={min(count, 20)}", f"marks={marks}", f"ends={shape[:1]}{shape[-1:]}",
        f"prev={near[0]}", f"next={near[1]}", f"prevcue={_CUES.sub('', before.lower())}", f"pair={near[0]}|{short}", f"pair2={short}|{near[1]}",
    )
    return [_slot(n) for n in names]


@dataclass
class CRF:
    emit: np.ndarray  # features x labels
    move: np.ndarray  # label x next label; the first row also serves as the start

    def decode(self, runs: list[list[list[int]]]) -> list[list[int]]:
        """Best label sequences of runs that stand between outside words."""
        out: list[list[int]] = [[] for _ in runs]
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        lo = 0
        while lo < len(order):
            # Runs are padded to the longest of their batch: as many as fit the cells, or one.
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(runs[order[hi]]) <= _CELLS:
                hi += 1
            for i, path in zip(order[lo:hi], self._decode_batch([runs[i] for i in order[lo:hi]]), strict=True):
                out[i] = path
            lo = hi
        return out

    def _decode_batch(self, runs: list[list[list[int]]]) -> list[list[int]]:
        size = np.array([len(r) for r in runs])
        longest = int(size.max())
        score = np.zeros((longest, len(runs), len(LABELS)))
        for row, r in enumerate(runs):
            for at in range(0, len(r), _CELLS):
                score[at : at + _CELLS, row][: len(r) - at] = self.emit[np.array(r[at : at + _CELLS])].sum(1)
        best = score[0] + self.move[0]
        back = np.zeros((longest, len(runs), len(LABELS)), np.int8)
        for t in range(1, longest):
            step = best[:, :, None] + self.move
            back[t] = step.argmax(1)
            best = np.where((t < size)[:, None], step.max(1) + score[t], best)
        last = (best + self.move[:, 0]).argmax(1)  # the next word is outside again
        out = []
        for row in range(len(runs)):
            label = int(last[row])
            path = [label]
            for t in range(int(size[row]) - 1, 0, -1):
                path.append(label := int(back[t, row, label]))
            out.append(path[::-1])
        return out


_ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])


def fit_crf(rows: list[tuple[str, list[tuple[str, int, int]]]], *, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> CRF:
    """Maximum likelihood by Adam on (text, [(kind, start, end)]) rows; deterministic."""
    sentences = []
    for text, spans in rows:
        words = [(m.start(), m.end(), m[0]) for m in _CANDIDATE.finditer(text)]
        gold = []
        for k, (lo, hi, _) in enumerate(words):
            own = next(((kind, s) for kind, s, e in spans if lo < e and hi > s), None)
            first = own is None or k == 0 or not (words[k - 1][0] <= own[1] < words[k - 1][1] or words[k - 1][0] >= own[1])
            gold.append(0 if own is None else LABELS.index(f"{'B' if first else 'I'}-{own[0]}"))
        for lo, hi in _runs([w[2] for w in words]):
            around = ["", *(w[2] for w in words), ""]
            sentences.append(([word_features(*around[k : k + 3]) for k in range(lo, hi)], gold[lo:hi]))
    width, labels = max(len(s) for s, _ in sentences), len(LABELS)
    n, f = len(sentences), len(sentences[0][0][0])
    x, y, on = np.zeros((n, width, f), np.int64), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for i, (s, g) in enumerate(sentences):
        x[i, : len(s)], y[i, : len(s)], on[i, : len(s)] = s, g, True
    size = on.sum(1)
    emit, move = np.zeros((_SIZE, labels)), np.where(_ALLOWED, 0.0, -1e4)
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    log = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    rows_at = np.arange(n)
    for step in range(1, rounds + 1):
        score = emit[x].sum(2)
        alpha, beta = np.zeros((n, width, labels)), np.zeros((n, width, labels))
        alpha[:, 0] = score[:, 0] + move[0]
        for t in range(1, width):
            alpha[:, t] = np.where(on[:, t, None], log(alpha[:, t - 1, :, None] + move, 1) + score[:, t], alpha[:, t - 1])
        beta[:, -1] = move[:, 0]
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(on[:, t + 1, None], log(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), move[:, 0])
        z = log(alpha[rows_at, size - 1] + move[:, 0], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
        node[rows_at[:, None], np.arange(width), y] -= on
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, x[on], node[on][:, None, :])
        g_move = node[:, 0].sum(0)[None, :] * (np.arange(labels) == 0)[:, None]
        for t in range(1, width):
            pair = np.exp(alpha[:, t - 1, :, None] + move + (score[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * on[:, t, None, None]
            g_move += pair.sum(0)
            np.add.at(g_move, (y[on[:, t], t - 1], y[on[:, t], t]), -1)
        end = np.exp(alpha[rows_at, size - 1] + move[:, 0] - z[:, None])
        g_move[:, 0] += end.sum(0)
        np.add.at(g_move, (y[rows_at, size - 1], 0), -1)
        for k, (w, g) in enumerate(((emit, g_emit / n + decay * emit), (move, np.where(_ALLOWED, g_move / n + decay * move, 0.0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return CRF(emit, move)


def _runs(words: list[str]) -> list[tuple[int, int]]:
    """Maximal runs of words that may lie in a span: those with a digit or an ``@``."""
    out, lo = [], None
    for k, w in enumerate([*words, ""]):
        may = "@" in w or any("0" <= c <= "9" for c in w)
        if may and lo is None:
            lo = k
        elif not may and lo is not None:
            out.append((lo, k))
            lo = None
    return out


_MAY = re.compile(r"[0-9@]")
_BREAK = re.compile(r"[\x20\x09-\x0D]")
_EDGES = " \t\n\v\f\r.,;:!?\"'<>[]{}"


_SPACE = frozenset(" \t\n\v\f\r")


def _word_before(text: str, at: int) -> str:
    """The whole word that ends before ``at``, where white space or the text begins."""
    hi = at
    while hi and text[hi - 1] in _SPACE:
        hi -= 1
    lo = hi
    while lo and text[lo - 1] not in _SPACE:
        lo -= 1
    return text[lo:hi]


def _text_runs(text: str) -> list[list[tuple[int, int, str, str, str]]]:
    """The runs of candidate words of a text: (start, end, word before, word, word after)."""
    out: list[list[tuple[int, int, str, str, str]]] = []
    at = 0
    last_end = -1
    while m := _MAY.search(text, at):
        lo = m.start()
        while lo > at and text[lo - 1] not in _SPACE:
            lo -= 1
        b = _BREAK.search(text, m.end())
        hi = b.start() if b else len(text)
        word = (lo, hi, _word_before(text, lo), text[lo:hi], m[0] if (m := _CANDIDATE.search(text, hi)) else "")
        if out and not text[last_end:lo].strip(" \t\n\v\f\r"):
            out[-1].append(word)
        else:
            out.append([word])
        at = last_end = hi
    return out


def _plausible(kind: int, s: str) -> bool:
    d = _digits(s)
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9]", s))
    if kind == 1:
        parts = _NUMBER.findall(s)
        return len(parts) == 4 and all(map(_is_octet, parts))
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15


def find_spans(texts: list[str | None], crf: CRF) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans with those that the CRF adds."""
    base = [base_spans(t or "") for t in texts]
    runs = [(k, run) for k, t in enumerate(texts) if t for run in _text_runs(t)]
    paths = crf.decode([[word_features(*w[2:]) for w in run] for _, run in runs])
    full = [list(b) for b in base]
    taken: dict[int, bytearray] = {}  # code points inside a span, of the texts that the CRF may add to
    for (k, run), path in zip(runs, paths, strict=True):
        i = 0
        while i < len(path):
            if LABELS[path[i]][0] != "B":
                i += 1
                continue
            kind, j = (path[i] - 1) // 2, i + 1
            while j < len(path) and path[j] == path[i] + 1:
                j += 1
            lo, hi = run[i][0], run[j - 1][1]
            while lo < hi and texts[k][lo] in _EDGES:
                lo += 1
            while hi > lo and texts[k][hi - 1] in _EDGES:
                hi -= 1
            if _plausible(kind, texts[k][lo:hi]):
                if k not in taken:
                    taken[k] = bytearray(len(texts[k]))
                    for s, _, e in base[k]:
                        taken[k][s:e] = b"\1" * (e - s)
                if taken[k].find(1, lo, hi) < 0:
                    taken[k][lo:hi] = b"\1" * (hi - lo)
                    full[k].append((lo, kind, hi))
            i = j
    return [(b, sorted(f)) for b, f in zip(base, full, strict=True)]


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SCHEMA = "doc_id {}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def find_personal_data(documents: DataFrame, crf: CRF, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts per kind, base spans and all spans as text."""
    held = documents.sparkSession.sparkContext.broadcast(crf)
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = find_spans(batch.column(1).to_pylist(), held.value)
            counts = [pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array([render(b) for b, _ in found], pa.string()),
                    pa.array([render(f) for _, f in found], pa.string()),
                ],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"],
            )

    return documents.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text").mapInArrow(run, _SCHEMA.format(kind))


def labelled_examples() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table, built from carrier phrases and a counting rule.

    ``{}`` marks the value; its kind is None where the value is no personal data.
    """
    carriers = (
        "call me on {} today",
        "my number is {} .",
        "{} is on file",
        "tel. {} or write",
        "the {} was noted",
        "see {} and then",
        "phone: {}, please",
        "and {} ed the",
        "reach us at {}.",
    )
    values: list[tuple[str | None, str]] = []
    for k in range(40):
        a, b, c = 200 + 37 * k % 700, 100 + 53 * k % 900, 1000 + 7919 * k % 9000
        values += [
            ("phone", f"({a}) {b}-{c}"), ("phone", f"{a}-{b}-{c}"), ("phone", f"+{1 + k % 90} ({a}) {b}-{c}"), ("phone", f"+{1 + k % 90} {a} {b} {c}"), ("phone", f"00{30 + k} {a} {b}{c}"), ("phone", f"{a}.{b}.{c}"), ("phone", f"0{a} {b}{c}"),
            ("ip", f"{k + 10}.{a % 256}.{b % 256}.{c % 256}"), ("email", f"name{k}@host{a}.example.com"), ("email", f"first.last@mail{k}.example.org"), ("email", f"user{a}@localhost"),
            ("card", f"4{a}{b}{c}{a}{k % 10}1"), ("card", f"4{a} {c} {c + 3} {a}{k % 10}"), ("card", f"5{a}-{c}-{c}-{a}{k % 10}"),
            (None, f"{1 + k % 9}.{k % 10}."), (None, f"version {k}."), (None, f"{k}.{k % 10}"), (None, f"{1950 + k}"), (None, f"20{10 + k}-0{1 + k % 9}-1{k % 10}"), (None, f"{k % 24}:{10 + k}"), (None, f"${a}.{10 + k}"), (None, f"{a},{b}"),
            (None, f"password={b:x}{c:x}{a:x}{b * c:x}"), (None, f'"{a * c:x}{b * c:x}{a * b * c:x}"'), (None, f"AKIA{k}HK{a}VB{k}C"), (None, f"@{k} things"), (None, f"v{k}.{a}.{b}"), (None, f"#{a}"), (None, f"{a}%"), (None, f"{k} of {a}"), (None, f"1{k}-1{k}"), (None, f"{c} {a}"), (None, f"[{k}]"), (None, f"ISBN 978-{k}-{b}-{a}-{k % 10}"),
            (None, f"{1900 + k}-{1905 + k}"), (None, f"{a}x{b}"), (None, f"{c}{b}"), (None, f"{k % 28 + 1}/{1 + k % 12}/{1990 + k}"),
        ]
    out = []
    for k, (kind, value) in enumerate(values):
        text = carriers[k % len(carriers)]
        lo = text.index("{}")
        out.append((text.replace("{}", value), [(kind, lo, lo + len(value))] if kind else []))
    return out
