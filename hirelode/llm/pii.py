"""Personal data in texts: exact base patterns, and spans added by a linear-chain CRF.

Base spans (leftmost, not overlapping within a kind; a match that fails its test is
dropped without a retry): e-mail addresses, IPv4 addresses with parts up to 255,
card numbers of 13 to 19 digits that pass Luhn, international phone numbers of 9
to 15 digits.  They always stay.

The CRF reads whitespace tokens of the lines that hold a digit or an ``@`` (a line
without either can hold none of the four kinds) as word shapes: runs of letters
and digits with their lengths, marks, first and last characters, a checksum bit
of long numbers, and the shapes of both neighbours.  It is trained by gradient
ascent on the conditional likelihood of a small labelled table of lines, and
decoded by Viterbi over batches of lines of like length.  A decoded span is added
where it overlaps no base span, every token in it is at least ``SURE`` certain
(forward-backward), and it holds a digit.

Defined results: a null text is empty and has no spans; spans count code points,
end exclusive; repeated rows each give a row; an empty labelled table adds nothing.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
BUCKETS = 1 << 13
LINES = 2000        # bound of the labelled table
NEAR = 12           # tokens kept on each side of a token with a digit or @ in training
SURE = 0.95

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by kind, then start."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        if domain and start < at:
            found.append(("email", start, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    # a match can only begin where a run of digits does, so longer runs need no second look
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def _shape(token: str) -> tuple[str, ...]:
    """Shape features of a token."""
    if token.isalpha():
        return ("word", "caps" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "low")
    runs = re.sub(r"[^\W\d_]+", "x", token)
    digits = NOT_DIGIT.sub("", token)
    exact = re.sub(r"[0-9]+", lambda m: f"d{len(m[0])}" if len(m[0]) < 20 else "d+", runs)
    coarse = re.sub(r"[0-9]+", "d", runs)
    bare = re.sub(r"[^x0-9d@.+()-]", "", coarse)
    out = ["e" + exact[:60], "c" + coarse[:60], "b" + bare[:60], f"n{min(len(digits), 20)}", f"l{min(len(token), 24)}",
           "f" + ("d" if token[0].isdigit() else "x" if token[0].isalpha() else token[0]),
           "z" + ("d" if token[-1].isdigit() else "x" if token[-1].isalpha() else token[-1]),
           f"@{token.count('@')}.{min(4, token.count('.'))}"]
    if len(digits) >= 13:
        out.append(f"luhn{luhn(digits)}{len(digits) <= 19}")
    if token.count(".") == 3 and digits:
        parts = [p for p in NOT_DIGIT.split(token) if p]
        out.append(f"octets{len(parts)}{all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    return tuple(out)


def _slot(feature: str) -> int:
    return int.from_bytes(sha256(feature.encode("utf-8", "surrogatepass")).digest()[:4], "big") % BUCKETS


class Shapes:
    """Numbers of the shapes met so far, with their feature slots as token, as left and as right neighbour."""

    def __init__(self):
        self.known: dict[tuple, int] = {("edge",): 0}
        self.slots = [self._slots(("edge",))]
        self.laid = 0

    @staticmethod
    def _slots(shape: tuple) -> list[list[int]]:
        near = shape[:3]
        return [[_slot("t:" + f) for f in (*shape, "bias")], [_slot("p:" + f) for f in near], [_slot("q:" + f) for f in near]]

    def number(self, token: str) -> int:
        shape = _shape(token)
        n = self.known.get(shape)
        if n is None:
            n = self.known[shape] = len(self.slots)
            self.slots.append(self._slots(shape))
        return n

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Label scores of every known shape: as the token, as its left and as its right neighbour."""
        if self.laid != len(self.slots):                          # lay the slots out once for each growth
            self.flat = [np.array([s for three in self.slots for s in three[j]]) for j in range(3)]
            self.cuts = [np.cumsum([0] + [len(three[j]) for three in self.slots])[:-1] for j in range(3)]
            self.laid = len(self.slots)
        return np.stack([np.add.reduceat(weights[self.flat[j]], self.cuts[j], axis=0) for j in range(3)])


def _emissions(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Scores of padded rows of shape numbers (edge shape 0 around them)."""
    left = np.concatenate([np.zeros_like(ids[:, :1]), ids[:, :-1]], axis=1)
    right = np.concatenate([ids[:, 1:], np.zeros_like(ids[:, :1])], axis=1)
    return table[0][ids] + table[1][left] + table[2][right]


ALLOWED = np.zeros((len(LABELS), len(LABELS)))
for _j, _name in enumerate(LABELS):
    if _name[0] == "I":
        ALLOWED[:, _j] = -1e4
        ALLOWED[_j, _j] = ALLOWED[_j - 1, _j] = 0.0
START = np.where([name[0] == "I" for name in LABELS], -1e4, 0.0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(e: np.ndarray, length: np.ndarray, move: np.ndarray):
    """Forward-backward: log marginals of labels, expected moves (per row sums) and log normaliser."""
    n, steps, k = e.shape
    ahead, back = np.zeros_like(e), np.zeros_like(e)
    ahead[:, 0] = e[:, 0] + START
    for t in range(1, steps):
        nxt = _logsum(ahead[:, t - 1, :, None] + move, 1) + e[:, t]
        ahead[:, t] = np.where((t < length)[:, None], nxt, ahead[:, t - 1])
    total = _logsum(ahead[:, -1], 1)
    for t in range(steps - 2, -1, -1):
        prev = _logsum(move + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where((t + 1 < length)[:, None], prev, 0.0)
    marginal = ahead + back - total[:, None, None]
    moves = np.zeros((k, k))
    for t in range(1, steps):
        live = t < length
        if live.any():
            moves += np.exp(ahead[live, t - 1, :, None] + move + (e[live, t] + back[live, t])[:, None, :] - total[live, None, None]).sum(0)
    return marginal, moves, total


def _padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(r) for r in rows])
    ids = np.zeros((len(rows), max(1, int(length.max(initial=1)))), dtype=np.int64)
    for i, r in enumerate(rows):
        ids[i, :len(r)] = r
    return ids, length


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 25) -> dict | None:
    """Weights from labelled lines (text and its spans)."""
    shapes, rows, gold = Shapes(), [], []
    for text, spans in labelled:
        tokens = list(TOKEN.finditer(text))
        marked = [0] * len(tokens)
        for kind, a, b in spans:
            inside = [i for i, m in enumerate(tokens) if m.start() < b and m.end() > a]
            for j, i in enumerate(inside):
                marked[i] = 1 + 2 * KINDS.index(kind) + (j > 0)
        hot = [i for i, m in enumerate(tokens) if re.search("[0-9@]", m[0])]
        at = 0
        while at < len(hot):                                     # windows around the tokens that matter
            last = at
            while last + 1 < len(hot) and hot[last + 1] - hot[last] <= 2 * NEAR and hot[last + 1] - hot[at] < 60:
                last += 1
            a, b = max(0, hot[at] - NEAR), hot[last] + NEAR + 1
            rows.append([shapes.number(m[0]) for m in tokens[a:b]])
            gold.append(marked[a:b])
            at = last + 1
    if not rows:
        return None
    k, rng = len(LABELS), np.random.default_rng(3)
    w, move = np.zeros((BUCKETS, k)), np.zeros((k, k))
    sum_w, sum_m = np.full_like(w, 1e-6), np.full_like(move, 1e-6)
    for r in range(rounds):
        for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            ids, length = _padded([rows[i] for i in pick])
            truth, _ = _padded([gold[i] for i in pick])
            live = np.arange(ids.shape[1]) < length[:, None]
            marginal, moves, _ = _marginals(_emissions(ids, shapes.scores(w)), length, move + ALLOWED)
            gap = np.where(live[:, :, None], np.eye(k)[truth] - np.exp(np.minimum(marginal, 0)), 0.0)
            grad = np.zeros_like(w)
            left = np.concatenate([np.zeros_like(ids[:, :1]), ids[:, :-1]], axis=1)
            right = np.concatenate([ids[:, 1:], np.zeros_like(ids[:, :1])], axis=1)
            for which, where in enumerate((ids, left, right)):
                by_shape = np.zeros((len(shapes.slots), k))
                np.add.at(by_shape, where.ravel(), gap.reshape(-1, k))
                for s in np.unique(where):
                    grad[shapes.slots[s][which]] += by_shape[s]
            seen = np.zeros_like(move)
            both = live[:, 1:]
            np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
            grad -= 1e-3 * w
            sum_w += grad**2
            w += 0.3 * grad / np.sqrt(sum_w)
            step = seen - moves - 1e-3 * move
            sum_m += step**2
            move += 0.3 * step / np.sqrt(sum_m)
    return {"w": w, "move": move}


def viterbi(e: np.ndarray, length: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best label of every token of a padded batch."""
    n, steps, k = e.shape
    best, come = e[:, 0] + START, np.zeros((n, steps, k), dtype=np.int8)
    for t in range(1, steps):
        both = best[:, :, None] + move
        come[:, t] = both.argmax(1)
        best = np.where((t < length)[:, None], both.max(1) + e[:, t], best)
    path = np.zeros((n, steps), dtype=np.int64)
    now = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        path[:, t] = np.where(t < length, now, 0)
        now = np.where((t < length) & (t > 0), come[np.arange(n), t, now], now)
    return path


class Tagger:
    """Decoder with the learned weights; keeps the shapes it has met."""

    def __init__(self, model: dict):
        self.w, self.move = model["w"], model["move"] + ALLOWED
        self.shapes = Shapes()

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text beyond its base spans."""
        lines = []                                            # text, tokens as (start, end)
        for i, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                if re.search("[0-9@]", line):
                    lines.append((i, [(at + m.start(), at + m.end()) for m in TOKEN.finditer(line)]))
                at += len(line) + 1
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        lines = sorted((x for x in lines if x[1]), key=lambda x: len(x[1]))
        begin = 0
        while begin < len(lines):
            end = begin + 1
            while end < len(lines) and end - begin < 256 and len(lines[end][1]) * (end - begin + 1) <= 40_000:
                end += 1
            part = lines[begin:end]
            ids, length = _padded([[self.shapes.number(texts[i][a:b]) for a, b in tokens] for i, tokens in part])
            e = _emissions(ids, self.shapes.scores(self.w))
            if len(self.shapes.slots) > 50_000:                   # bounds what a task remembers
                self.shapes = Shapes()
            path = viterbi(e, length, self.move)
            rows = np.flatnonzero(path.any(1))
            if len(rows):
                sure, _, _ = _marginals(e[rows], length[rows], self.move)
                for at, r in enumerate(rows):
                    self._spans(part[r], path[r], np.exp(sure[at]), texts, base, out)
            begin = end
        return [sorted(s, key=lambda x: (KINDS.index(x[0]), x[1])) for s in out]

    @staticmethod
    def _spans(line, path, sure, texts, base, out) -> None:
        i, tokens = line
        t = 0
        while t < len(tokens):
            label = int(path[t])
            if not label:
                t += 1
                continue
            last, kind = t, (label - 1) // 2
            while last + 1 < len(tokens) and path[last + 1] == 2 + 2 * kind:
                last += 1
            certain = all(sure[j, path[j]] >= SURE for j in range(t, last + 1))
            a, b = tokens[t][0], tokens[last][1]
            text = texts[i]
            while a < b and not (text[a].isalnum() or text[a] == "+"):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if certain and a < b and re.search("[0-9]", text[a:b]) and all(b <= s or a >= z for _, s, z in base[i]):
                out[i].append((KINDS[kind], a, b))
            t = last + 1


def labelled_lines(docs: DataFrame, lines: int = LINES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A labelled table of at most ``lines`` short lines with digits or ``@``, from as many documents that have any."""
    some = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    line = (
        sampled(some, lines, some.count(), "text").select(F.explode(F.split("text", "\n")).alias("line"))
        .where(F.col("line").rlike("[0-9@]") & (F.char_length("line") <= 4000)).distinct()
        .orderBy(F.xxhash64("line"), "line").limit(lines))
    return [(r["line"], base_spans(r["line"])) for r in line.collect()]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row for each document row: doc_id, counts of base spans by kind, base digest, all spans, number added."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = [x.split()[0] for x in schema.split(", ")]
    empty = sha256(b"").hexdigest()

    def search(batches):
        tagger = Tagger(model) if model is not None else None
        for b in batches:
            column = b.column("text")
            hot = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)
            n = b.num_rows
            counts, digest, spans, more = np.zeros((n, 4), np.int64), [empty] * n, [""] * n, np.zeros(n, np.int64)
            where = np.flatnonzero(hot.to_numpy(zero_copy_only=False))
            for a in range(0, len(where), 256):
                rows = where[a:a + 256]
                texts = column.take(pa.array(rows)).to_pylist()
                base = [base_spans(t) for t in texts]
                extra = tagger.added(texts, base) if tagger else [[] for _ in texts]
                for r, own, new in zip(rows, base, extra, strict=True):
                    for kind, _, _ in own:
                        counts[r, KINDS.index(kind)] += 1
                    digest[r] = sha256(joined(own).encode()).hexdigest()
                    spans[r] = joined(sorted(own + new, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
                    more[r] = len(new)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(counts[:, k]) for k in range(4)], pa.array(digest), pa.array(spans), pa.array(more)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, schema)
